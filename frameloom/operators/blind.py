"""Beamformers whose active weights are fitted to an utterance: greatest kurtosis or negentropy of one output, least mutual information of
two, and separation under geometric constraints.

A group is one utterance's bin: its frames (few thousand snapshots of few channels) are fitted as a whole in one task, bins and
utterances side by side. Weights are w = wq - B wa with a blocking matrix B, so the look direction keeps its gain.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from .activity import generalised_log_likelihood
from .batch import per_group
from .beamforming import blocking_matrix


def descend(f, x: np.ndarray, rounds: int = 60, step: float = 0.1, tolerance: float = 1e-7) -> np.ndarray:
    """Conjugate gradients (Polak and Ribiere) with gradients by central differences and steps that are halved until they go down."""
    x = np.asarray(x, float).copy()
    at, last, way = f(x), None, None
    small = 1e-5
    for _ in range(rounds):
        g = np.array([(f(x + e) - f(x - e)) / (2 * small) for e in small * np.eye(len(x))])
        if np.abs(g).max(initial=0) < tolerance:
            break
        way = -g if last is None else -g + max(0.0, g @ (g - last) / max(last @ last, 1e-300)) * way
        if way @ g >= 0:
            way = -g
        size = step / max(np.linalg.norm(way), 1e-300)
        step = min(step * 2, 10.0)
        while size * np.linalg.norm(way) > 1e-10 and f(x + size * way) > at - 1e-4 * size * abs(way @ g):
            size /= 2
            step /= 2
        new = f(x + size * way)
        if not new < at - 1e-12 * max(1, abs(at)):
            break
        x, at, last = x + size * way, new, g
    return x


def _complex(v: np.ndarray) -> np.ndarray:
    return v[: len(v) // 2] + 1j * v[len(v) // 2 :]


def kurtosis(y: np.ndarray, beta: float = 3.0) -> float:
    """mean |y|^4 - beta (mean |y|^2)^2, over the squared power."""
    p = np.abs(y) ** 2
    return float((p**2).mean() / max(p.mean() ** 2, 1e-300) - beta)


def negentropy(y: np.ndarray, shape: float = 0.5) -> float:
    """Entropy of a Gaussian less that of a generalised Gaussian with the output's variance: how far from Gaussian it is."""
    p = np.abs(y) ** 2
    var = np.full(len(y), max(p.mean(), 1e-30))
    own = generalised_log_likelihood(p[:, None], var[:, None], np.array([shape])).mean()
    return float(own + math.log(math.pi * var[0]) + 1)


def _fitted(x: np.ndarray, d: np.ndarray, goal, alpha: float, rounds: int) -> np.ndarray:
    q, b = d / len(d), blocking_matrix(d)
    scale = max(np.abs(x).mean(), 1e-300)
    z = x / scale

    def cost(v: np.ndarray) -> float:
        return -goal(z @ (q - b @ _complex(v)).conj()) + alpha * v @ v

    return q - b @ _complex(descend(cost, np.zeros(2 * b.shape[1]), rounds))


def _rows(rows: list[dict]) -> tuple[list[dict], np.ndarray]:
    rows = sorted(rows, key=lambda r: r["frame"])
    return rows, np.array([np.asarray(r["re"]) + 1j * np.asarray(r["im"]) for r in rows])


def fitted_beam(df: DataFrame, manifold: np.ndarray, criterion: str = "kurtosis", keys: tuple[str, ...] = ("utt",), alpha: float = 1e-2, rounds: int = 60, shape: float = 0.5) -> DataFrame:
    """One output per frame and bin with active weights of greatest kurtosis or negentropy: rows (keys, bin, frame, re, im over channels) ->
    (keys, bin, frame, re, im). `alpha` holds the weights small; manifold is (bin x channel)."""
    goal = {"kurtosis": kurtosis, "negentropy": lambda y: negentropy(y, shape)}[criterion]
    sent = df.sparkSession.sparkContext.broadcast(manifold)

    def run(rows: list[dict]) -> list[dict]:
        rows, x = _rows(rows)
        y = x @ _fitted(x, sent.value[int(rows[0]["b"])], goal, alpha, rounds).conj()
        return [{"frame": r["frame"], "re": float(v.real), "im": float(v.imag)} for r, v in zip(rows, y, strict=True)]

    from pyspark.sql import functions as F

    return per_group(df.select(*keys, "bin", F.col("bin").alias("b"), "frame", "re", "im"), [*keys, "bin"], run, "frame long, re double, im double")


def log_density(y: np.ndarray, kind: str = "gauss") -> np.ndarray:
    """ln density, but for constants, of jointly circular vectors (frame x output) under spherically invariant models with their own covariance:
    gauss, laplace, k0 and gamma differ in how they fall with s = y^H C^-1 y."""
    n = y.shape[1]
    c = y.T @ y.conj() / len(y) + 1e-12 * np.eye(n)
    s = np.maximum(np.einsum("fi,ij,fj->f", y.conj(), np.linalg.inv(c).T, y).real, 1e-12)
    det = math.log(max(np.linalg.det(c).real, 1e-300))
    root = np.sqrt(s)
    fall = {"gauss": s, "laplace": 2 * root + (n - 0.5) / 2 * np.log(s), "k0": root + n / 2 * np.log(s) + 0.5 * np.log1p(root), "gamma": math.sqrt(3) / 2 * root + (n - 0.5) / 2 * np.log(s)}[kind]
    return -fall - det


def mutual_information(y: np.ndarray, kind: str = "gauss") -> float:
    """Mean of ln joint density less the sum of the marginal ones; for the Gaussian model it is -ln(1 - |rho|^2)."""
    joint = log_density(y, kind).mean()
    return float(joint - sum(log_density(y[:, k : k + 1], kind).mean() for k in range(y.shape[1])))


def separated_beams(df: DataFrame, manifolds: np.ndarray, kind: str = "gauss", keys: tuple[str, ...] = ("utt",), alpha: float = 1e-3, rounds: int = 60) -> DataFrame:
    """Two sources, one output each, with active weights under which the outputs tell least about each other: manifolds is (source x bin x
    channel); (keys, bin, frame, re, im) with vectors over sources."""
    sent = df.sparkSession.sparkContext.broadcast(manifolds)

    def run(rows: list[dict]) -> list[dict]:
        rows, x = _rows(rows)
        d = sent.value[:, int(rows[0]["b"])]
        q = [v / len(v) for v in d]
        b = [blocking_matrix(v) for v in d]
        z = x / max(np.abs(x).mean(), 1e-300)
        k = 2 * b[0].shape[1]
        out = lambda v, u: np.stack([u @ (q[s] - b[s] @ _complex(v[s * k : (s + 1) * k])).conj() for s in (0, 1)], 1)
        v = descend(lambda v: mutual_information(out(v, z), kind) + alpha * v @ v, np.zeros(2 * k), rounds)
        return [{"frame": r["frame"], "re": y.real.tolist(), "im": y.imag.tolist()} for r, y in zip(rows, out(v, x), strict=True)]

    from pyspark.sql import functions as F

    return per_group(df.select(*keys, "bin", F.col("bin").alias("b"), "frame", "re", "im"), [*keys, "bin"], run, "frame long, re array<double>, im array<double>")


def null_weights(look: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Least weights (bin x channel) with response one to the look manifold and zero to the other."""
    d = np.stack([look, null], -1)
    inner = np.swapaxes(d.conj(), -1, -2) @ d + 1e-9 * np.eye(2)
    return (d @ np.linalg.solve(inner, np.broadcast_to(np.array([1, 0]), (*inner.shape[:-2], 2))[..., None]))[..., 0]


def geometric_separation(covariance: np.ndarray, manifolds: np.ndarray, penalty: float = 1.0, rounds: int = 100, rate: float = 0.1) -> np.ndarray:
    """Geometric source separation for one bin (Parra and Alvino, 2002): W (source x channel) for which W R W^H is nearest to diagonal, held
    near W D = 1, by gradient steps scaled by the power; manifolds D is (channel x source)."""
    w = np.linalg.pinv(manifolds)
    r = covariance
    for _ in range(rounds):
        e = w @ r @ w.conj().T
        e = e - np.diag(np.diag(e))
        g = 4 * e @ w @ r / max(np.trace(r).real ** 2, 1e-300) + 2 * penalty * (w @ manifolds - np.eye(len(w))) @ manifolds.conj().T / len(manifolds)
        w = w - rate * g
    return w
