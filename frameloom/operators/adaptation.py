"""Speaker adaptation: transforms of means and frames, their estimation from statistics, and speaker-adaptive training.

Statistics are sums per speaker and Gaussian, gathered batch by batch (gaussians.statistics); from there on everything has the
size of models. Estimators solve one speaker's (or class's) system per group, so speakers run side by side.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import per_group, sums, vectors
from .gaussians import Book

# sequences of all-pass maps


def cauchy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two Laurent series given on places -n..n, cut to the same places."""
    n = (len(a) - 1) // 2
    return np.convolve(a, b)[n : n + len(a)]


def bilinear_series(mu: float, n: int) -> np.ndarray:
    """Series of (z - mu) / (1 - mu z) on places -n..n: -mu, 1 - mu^2, then each mu times the one before."""
    if abs(mu) >= 1:
        raise ValueError("the parameter lies inside the unit circle")
    out = np.zeros(2 * n + 1)
    out[n] = -mu
    out[n + 1 :] = (1 - mu * mu) * mu ** np.arange(n)
    return out


def rational_series(mu: float, pairs: list[tuple[complex, complex]], n: int, points: int = 4096) -> np.ndarray:
    """Bilinear series times rational all-pass factors: each pair (b, g) of points inside the circle adds zeros at b and its conjugate and
    takes them away at g and its conjugate, so that the map still winds once. Expanded by a transform on the unit circle."""
    z = np.exp(2j * np.pi * np.arange(points) / points)
    one = lambda b: (z - b) / (1 - np.conj(b) * z)
    q = one(mu)
    for b, g in pairs:
        q = q * one(b) * one(np.conj(b)) / (one(g) * one(np.conj(g)))
    c = np.fft.fft(q) / points
    return np.array([c[k % points].real for k in range(-n, n + 1)])


def sine_log_series(parameters: list[float], n: int, points: int = 4096) -> np.ndarray:
    """Series of z exp(sum_k a_k pi / 2 (z^k - z^-k)): the sine-log all-pass map, as the exponential's series."""
    w = 2 * np.pi * np.arange(points) / points
    phase = w + sum((math.pi * a * np.sin((k + 1) * w) for k, a in enumerate(parameters)), np.zeros(points))
    c = np.fft.fft(np.exp(1j * phase)) / points
    return np.array([c[k % points].real for k in range(-n, n + 1)])


def cepstral_matrix(series: np.ndarray, size: int, original: int | None = None) -> np.ndarray:
    """Linear map of cepstra (size x original) of a map's series q: column m has the coefficients of q^m, those at negative places folded onto
    the positive ones; the zeroth cepstrum stays."""
    original = original or size
    n = (len(series) - 1) // 2
    if n < max(size, original):
        raise ValueError("the series is too short")
    out = np.zeros((size, original))
    power = np.zeros(2 * n + 1)
    power[n] = 1
    for m in range(original):
        if m:
            power = cauchy(power, series)
        out[0, m] = power[n] if m else 1.0
        out[1:, m] = power[n + 1 : n + size] + (power[n - 1 : n - size : -1] if size > 1 else 0)
    return out


# transforms


def transform_frames(df: DataFrame, matrix: np.ndarray, bias: np.ndarray | None = None, blocks: int = 1) -> DataFrame:
    """v -> A v + b, where a vector of `blocks` parts has the matrix applied to each part (or one matrix per part)."""
    a = np.asarray(matrix, float)
    parts = a if a.ndim == 3 else np.broadcast_to(a, (blocks, *a.shape))
    b = np.zeros(parts.shape[0] * parts.shape[1]) if bias is None else np.asarray(bias, float)

    def run(x: np.ndarray) -> np.ndarray:
        y = np.einsum("bij,nbj->nbi", parts, x.reshape(len(x), parts.shape[0], -1))
        return y.reshape(len(x), -1) + b

    return df.withColumn("v", vectors(run, "array<double>", "v"))


def transform_by_class(df: DataFrame, transforms: dict, column: str) -> DataFrame:
    """v -> A v + b with the transform of the row's class (a regression class or a speaker) from a table of (A, b); rows of classes without one stay."""
    sent = df.sparkSession.sparkContext.broadcast(transforms)

    def run(c: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = x.astype(float).copy()
        for k in dict.fromkeys(c.tolist()):
            if k in sent.value:
                a, b = sent.value[k]
                rows = c == k
                out[rows] = x[rows] @ a.T + b
        return out

    return df.withColumn("v", vectors(run, "array<double>", column, "v"))


def adapt_means(book: Book, matrix: np.ndarray, bias: np.ndarray | None = None) -> Book:
    return Book(book.classes, book.mu @ np.asarray(matrix).T + (0 if bias is None else bias), book.var, book.weights)


# estimation


def _matrix_rows(speaker_column: str, dims: int) -> str:
    return "matrix array<array<double>>, bias array<double>, occ double"


def _solve(g: np.ndarray, z: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Least squares with singular values under floor times the largest left out."""
    u, s, vt = np.linalg.svd(g, hermitian=True)
    keep = s > floor * max(s.max(initial=0), 1e-300)
    return vt[keep].T @ ((u[:, keep].T @ z) / s[keep])


def linear_regression_transform(stats: list[dict], book: Book, bias: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood linear regression of means: rows of [A | b] by the normal equations of each dimension, over statistics
    (label, occ, first) of one speaker or class."""
    at = {c: k for k, c in enumerate(book.classes)}
    rows = [(at[s["label"]], s["occ"], np.asarray(s["first"], float)) for s in stats if s["label"] in at]
    d = book.mu.shape[1]
    ext = np.column_stack([book.mu, np.ones(len(book.mu))]) if bias else book.mu
    out = np.zeros((d, ext.shape[1]))
    for i in range(d):
        g, z = np.zeros((ext.shape[1],) * 2), np.zeros(ext.shape[1])
        for k, occ, first in rows:
            g += occ / book.var[k, i] * np.outer(ext[k], ext[k])
            z += first[i] / book.var[k, i] * ext[k]
        out[i] = _solve(g, z)
    return out[:, :d], out[:, d] if bias else np.zeros(d), sum(r[1] for r in rows)


def regression_transforms(stats: DataFrame, book: Book, by: str, bias: bool = True) -> DataFrame:
    """MLLR for each value of `by` (speaker, or regression class): (by, matrix, bias, occ)."""
    sent = stats.sparkSession.sparkContext.broadcast(book)

    def run(rows: list[dict]) -> list[dict]:
        a, b, occ = linear_regression_transform(rows, sent.value, bias)
        return [{"matrix": a.tolist(), "bias": b.tolist(), "occ": float(occ)}]

    return per_group(stats.select(by, "label", "occ", "first"), [by], run, _matrix_rows(by, 0))


def brent(f, low: float, high: float, tolerance: float = 1e-6, rounds: int = 100) -> float:
    """Least point of a function of one variable by golden sections with parabolic steps (Brent, 1973)."""
    g = (3 - math.sqrt(5)) / 2
    x = w = v = low + g * (high - low)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(rounds):
        m = (low + high) / 2
        tol = tolerance * abs(x) + 1e-10
        if abs(x - m) <= 2 * tol - (high - low) / 2:
            break
        p = q = r = 0.0
        if abs(e) > tol:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
        if abs(p) < abs(q * e / 2) and q * (low - x) < p < q * (high - x):
            e, d = d, p / q
        else:
            e = (high if x < m else low) - x
            d = g * e
        u = x + (d if abs(d) >= tol else math.copysign(tol, d))
        fu = f(u)
        if fu <= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            low, high = (u, high) if u < x else (low, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def all_pass_parameters(stats: list[dict], book: Book, blocks: int = 1, kind: str = "bilinear", count: int = 1, rounds: int = 6, reach: float = 0.4) -> np.ndarray:
    """Parameters of a bilinear or sine-log map of the means' cepstra under which one speaker's statistics are likeliest: one-dimensional
    searches in turn, `rounds` times over the parameters."""
    size = book.mu.shape[1] // blocks
    at = {c: k for k, c in enumerate(book.classes)}
    rows = [(at[s["label"]], s["occ"], np.asarray(s["first"], float)) for s in stats if s["label"] in at]

    def cost(p: np.ndarray) -> float:
        q = bilinear_series(p[0], 4 * size) if kind == "bilinear" else sine_log_series(list(p), 4 * size)
        m = cepstral_matrix(q, size)
        mu = np.einsum("ij,nbj->nbi", m, book.mu.reshape(len(book.mu), blocks, size)).reshape(len(book.mu), -1)
        return sum(float(((occ * mu[k] ** 2 - 2 * mu[k] * first) / book.var[k]).sum()) for k, occ, first in rows) / 2

    p = np.zeros(1 if kind == "bilinear" else count)
    for _ in range(rounds if len(p) > 1 else 1):
        for i in range(len(p)):
            p[i] = brent(lambda x, i=i: cost(np.concatenate([p[:i], [x], p[i + 1 :]])), -reach, reach)
    return p


def warp_parameters(stats: DataFrame, book: Book, by: str, blocks: int = 1, kind: str = "bilinear", count: int = 1) -> DataFrame:
    """(by, parameters) of the likeliest all-pass map of each speaker."""
    sent = stats.sparkSession.sparkContext.broadcast(book)
    run = lambda rows: [{"parameters": all_pass_parameters(rows, sent.value, blocks, kind, count).tolist()}]
    return per_group(stats.select(by, "label", "occ", "first"), [by], run, "parameters array<double>")


def class_covariances(df: DataFrame, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """Occupancy and whole covariance of each class of a book around its mean, summed batch by batch."""
    from .gaussians import class_moments

    d = book.mu.shape[1]
    occ, cov = np.zeros(len(book.classes)), np.zeros((len(book.classes), d, d))
    at = {c: k for k, c in enumerate(book.classes)}
    for r in class_moments(df).collect():
        if r["label"] in at:
            s, k = np.array(r["s"]), at[r["label"]]
            mu = book.mu[k]
            occ[k] = s[0]
            cov[k] = s[1 + d :].reshape(d, d) / s[0] - np.outer(mu, s[1 : 1 + d] / s[0]) - np.outer(s[1 : 1 + d] / s[0], mu) + np.outer(mu, mu)
    return occ, cov


def semi_tied_transform(occ: np.ndarray, cov: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Semi-tied covariance transform (Gales, 1999): rows by cofactors, in turns with the classes' diagonal variances."""
    d = cov.shape[1]
    a = np.eye(d)
    total = occ.sum()
    for _ in range(rounds):
        var = np.einsum("ij,kjl,il->ki", a, cov, a).clip(1e-10)
        for i in range(d):
            g = np.einsum("k,kij->ij", occ / var[:, i], cov)
            c = np.linalg.inv(a).T[i] * np.linalg.det(a)
            inv = np.linalg.inv(g + 1e-10 * np.eye(d))
            a[i] = c @ inv * math.sqrt(total / max(c @ inv @ c, 1e-300))
        a /= abs(np.linalg.det(a)) ** (1 / d)
    return a


# speaker-adaptive training


def adaptive_means(stats: DataFrame, transforms: dict, book: Book, by: str, floor: float = 1e-6, threshold: float | None = None) -> DataFrame:
    """Means that are likeliest after each speaker's transform (A, b): per Gaussian, sum of n A' S A and A' S (first - n b) over
    speakers, solved with a floor of singular values; with `threshold`, only axes whose gain of likelihood is above it move from the old
    mean (description length). Speakers are summed within a Gaussian's group, which has one row per speaker. (label, mean, occ)."""
    sent = stats.sparkSession.sparkContext.broadcast((transforms, book))

    def run(rows: list[dict]) -> list[dict]:
        moves, book = sent.value
        k = book.classes.index(rows[0]["label_"])
        d = book.mu.shape[1]
        g, z, n = np.zeros((d, d)), np.zeros(d), 0.0
        for r in rows:
            a, b = moves.get(r[by], (np.eye(d), np.zeros(d)))
            g += r["occ"] * (a.T / book.var[k]) @ a
            z += (a.T / book.var[k]) @ (np.asarray(r["first"], float) - r["occ"] * b)
            n += r["occ"]
        if threshold is None:
            return [{"mean": _solve(g, z, floor).tolist(), "occ": float(n)}]
        value, axis = np.linalg.eigh(g)
        left = axis.T @ (z - g @ book.mu[k])
        gain = np.where(value > floor * max(value.max(initial=0), 1e-300), left**2 / np.maximum(value, 1e-300) / 2, 0.0)
        move = np.where(gain > threshold, left / np.maximum(value, 1e-300), 0.0)
        return [{"mean": (book.mu[k] + axis @ move).tolist(), "occ": float(n)}]

    known = stats.where(F.col("label").isin(book.classes)).withColumn("label_", F.col("label"))
    return per_group(known.select("label", "label_", by, "occ", "first"), ["label"], run, "mean array<double>, occ double")


def adaptive_variances(stats: DataFrame, transforms: dict, book: Book, by: str, floor: float = 1e-4) -> DataFrame:
    """Variances around each speaker's adapted means: (label, var)."""
    sent = stats.sparkSession.sparkContext.broadcast((transforms, book))

    def run(rows: list[dict]) -> list[dict]:
        moves, book = sent.value
        k = book.classes.index(rows[0]["label_"])
        d = book.mu.shape[1]
        total, n = np.zeros(d), 0.0
        for r in rows:
            a, b = moves.get(r[by], (np.eye(d), np.zeros(d)))
            m = a @ book.mu[k] + b
            total += np.asarray(r["second"], float) - 2 * m * np.asarray(r["first"], float) + r["occ"] * m**2
            n += r["occ"]
        return [{"var": np.maximum(total / max(n, 1e-300), floor).tolist()}]

    known = stats.where(F.col("label").isin(book.classes)).withColumn("label_", F.col("label"))
    return per_group(known.select("label", "label_", by, "occ", "first", "second"), ["label"], run, "var array<double>")


def regression_classes(book: Book, occ: np.ndarray, classes: int, rounds: int = 20) -> list[int]:
    """Class of each Gaussian by splitting the heaviest class in two, again and again, with 2-means on means scaled by their deviations."""
    x = book.mu / np.sqrt(book.var)
    label = np.zeros(len(x), int)
    for new in range(1, classes):
        heavy = max(range(new), key=lambda c: (occ[label == c].sum() if (label == c).sum() > 1 else -1.0))
        at = np.flatnonzero(label == heavy)
        if len(at) < 2:
            break
        spread = x[at].std(0)
        c = np.stack([np.average(x[at], 0, occ[at] + 1e-9) + s * 0.2 * spread for s in (1, -1)])
        for _ in range(rounds):
            side = ((x[at][:, None] - c[None]) ** 2).sum(2).argmin(1)
            for s in (0, 1):
                if (side == s).any():
                    c[s] = np.average(x[at][side == s], 0, occ[at][side == s] + 1e-9)
        if side.min() == side.max():
            break
        label[at[side == 1]] = new
    return label.tolist()


def full_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Occupancy, sums, and outer products per key, for full-covariance estimators: (keys, s)."""
    run = lambda r: np.concatenate([[len(r["v"])], r["v"].sum(0), (r["v"].T @ r["v"]).ravel()])
    return sums(df.where(F.col("v").isNotNull()).select(*keys, "v"), keys, run)
