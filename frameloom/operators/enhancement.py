"""Enhancement of complex subband signals: Wiener filter, spectral subtraction, post-filters of arrays and binary masks.

Rows are (frame, bin, re, im), with numbers for one channel and vectors over channels for arrays. Averages over time are
recursions per bin, so bins run side by side and only a bin's state travels along its frames.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import complex_of
from .batch import scan, sums

#: Least value of a post-filter.
SPECTRAL_FLOOR = 1e-4


class _Wiener:
    """PSD of signal and noise as recursive means whose first two frames aren't averaged."""

    def __init__(self, alpha: float, floor: float, beta: float):
        self.alpha, self.floor, self.beta = alpha, floor, beta
        self.frame, self.s, self.n = 0, 0.0, 0.0

    def step(self, rows: dict) -> dict:
        out = np.empty(len(rows["signal"]))
        for k, (s, n) in enumerate(zip(rows["signal"], rows["noise"], strict=True)):
            a = self.alpha if self.frame > 1 else 0.0
            self.s = a * self.s + (1 - a) * s
            self.n = a * self.n + (1 - a) * max(n, self.floor)
            whole = self.s + self.beta * self.n
            out[k] = self.s / whole if whole > 0 else 0.0
            self.frame += 1
        return {"gain": out}


def wiener_gain(powers: DataFrame, keys: list[str], order: str = "n", alpha: float = 0.0, floor: float = 0.001, beta: float = 1.0) -> DataFrame:
    """Gain S / (S + beta * N) from the powers `signal` and `noise` of two streams: (keys, order, gain); N has a floor, S and N are
    recursive means. Where both are zero the gain is 0."""
    return scan(powers.select(*keys, order, "signal", "noise"), keys, [order], lambda: _Wiener(alpha, floor, beta), "gain double", keep=[order])


def average_noise(df: DataFrame) -> DataFrame:
    """Mean power of each bin over noise frames: (bin, noise)."""
    return df.groupBy("bin").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("noise"))


def spectral_subtraction(df: DataFrame, noise: DataFrame, factor: float = 1.0, floor: float = 0.001) -> DataFrame:
    """Takes factor * noise power (bin, noise) from each bin's power, with a floor, and keeps the phase; bins without noise stay."""
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    left = df.join(F.broadcast(noise), "bin", "left").withColumn("__p", power)
    kept = F.greatest(F.col("__p") - factor * F.coalesce("noise", F.lit(0.0)), F.lit(floor))
    gain = F.when(F.col("__p") > 0, F.sqrt(kept / F.col("__p")))
    out = left.withColumn("__g", gain)
    re = F.when(F.col("__p") > 0, F.col("re") * F.col("__g")).otherwise(F.sqrt(F.lit(floor)))
    return out.withColumn("__re", re).withColumn("im", F.when(F.col("__p") > 0, F.col("im") * F.col("__g")).otherwise(0.0)).withColumn("re", F.col("__re")).drop("__p", "__g", "__re", "noise")


class _PostFilter:
    """Recursive auto and cross densities of time-aligned channels, and the gain that they give."""

    def __init__(self, alpha: float, gain):
        self.alpha, self.gain, self.r = alpha, gain, None

    def step(self, rows: dict) -> dict:
        out = np.empty(len(rows["re"]))
        for k, x in enumerate(complex_of(rows)):
            new = np.outer(x, x.conj())
            self.r = new if self.r is None or self.alpha <= 0 else self.alpha * self.r + (1 - self.alpha) * new
            out[k] = min(1.0, max(SPECTRAL_FLOOR, self.gain(self.r)))
        return {"gain": out}


def zelinski(aligned: DataFrame, alpha: float = 0.6, real: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Zelinski's post-filter of time-aligned snapshot vectors: mean cross density over mean auto density, kept within
    [1e-4, 1]: (keys, frame, gain)."""

    def gain(r: np.ndarray) -> float:
        n = len(r)
        cross = r[np.triu_indices(n, 1)].sum()
        total = np.trace(r).real
        return (max(cross.real, 0.0) if real else abs(cross)) / total * 2 / (n - 1) if total > 0 else 0.0

    keys = keys or ["bin"]
    return scan(aligned.select(*keys, "frame", "re", "im"), keys, ["frame"], lambda: _PostFilter(alpha, gain), "gain double", keep=["frame"])


def mccowan(aligned: DataFrame, coherence: dict[int, np.ndarray], alpha: float = 0.6, most: float = 0.99, keys: list[str] | None = None) -> DataFrame:
    """McCowan and Bourlard's post-filter: the clean density of each channel pair by a known noise coherence (a matrix per bin),
    averaged over pairs, over the mean auto density. Coherences are kept under `most`."""
    keys = keys or ["bin"]
    state = lambda b: _PostFilter(alpha, lambda r: _clean(r, coherence[b], most))

    class ByBin:
        def __init__(self):
            self.inner = None

        def step(self, rows: dict) -> dict:
            self.inner = self.inner or state(int(rows["bin"][0]))
            return self.inner.step(rows)

    return scan(aligned.select(*keys, "frame", "re", "im"), keys, ["frame"], ByBin, "gain double", keep=["frame"])


def _clean(r: np.ndarray, coherence: np.ndarray, most: float) -> float:
    i, j = np.triu_indices(len(r), 1)
    g = np.minimum(np.real(coherence[i, j]), most)
    d = np.diag(r).real
    clean = (r[i, j].real - g * (d[i] + d[j]) / 2) / (1 - g)
    total = d.mean()
    return max(clean.mean(), 0.0) / total if total > 0 else 0.0


def lefkimmiatis(aligned: DataFrame, coherence: dict[int, np.ndarray], weights: dict[int, np.ndarray], alpha: float = 0.6, most: float = 0.99, keys: list[str] | None = None) -> DataFrame:
    """Lefkimmiatis and Maragos' post-filter: clean density over clean density plus the noise that the beamformer's weights let
    through, with the noise density of each pair by the known coherence."""
    keys = keys or ["bin"]

    class ByBin:
        def __init__(self):
            self.inner = None

        def step(self, rows: dict) -> dict:
            if self.inner is None:
                c, w = coherence[int(rows["bin"][0])], weights[int(rows["bin"][0])]
                through = float(np.real(w.conj() @ c @ w))

                def gain(r: np.ndarray) -> float:
                    i, j = np.triu_indices(len(r), 1)
                    g, d = np.minimum(np.real(c[i, j]), most), np.diag(r).real
                    clean = max(((r[i, j].real - g * (d[i] + d[j]) / 2) / (1 - g)).mean(), 0.0)
                    noise = max((((d[i] + d[j]) / 2 - r[i, j].real) / (1 - g)).mean(), 0.0) * through
                    return clean / (clean + noise) if clean + noise > 0 else 0.0

                self.inner = _PostFilter(alpha, gain)
            return self.inner.step(rows)

    return scan(aligned.select(*keys, "frame", "re", "im"), keys, ["frame"], ByBin, "gain double", keep=["frame"])


def apply_gain(df: DataFrame, gains: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bins times their gain."""
    keys = keys or ["frame", "bin"]
    return df.join(gains.select(*keys, "gain"), keys).withColumn("re", F.col("re") * F.col("gain")).withColumn("im", F.col("im") * F.col("gain")).drop("gain")


def high_pass(df: DataFrame, cut_bin: int) -> DataFrame:
    """Bins from 1 to cut_bin - 1 become zero; bin 0 stays."""
    off = (F.col("bin") >= 1) & (F.col("bin") < cut_bin)
    return df.withColumn("re", F.when(off, 0.0).otherwise(F.col("re"))).withColumn("im", F.when(off, 0.0).otherwise(F.col("im")))


def level_mask(left: DataFrame, right: DataFrame, threshold: float, floor: float = 0.0) -> DataFrame:
    """Binary mask by the difference of the channels' levels: 1 where |left| >= threshold * |right|, else floor."""
    j = left.alias("l").join(right.alias("r"), ["frame", "bin"])
    power = lambda s: F.col(f"{s}.re") * F.col(f"{s}.re") + F.col(f"{s}.im") * F.col(f"{s}.im")
    return j.select("frame", "bin", F.when(power("l") >= threshold**2 * power("r"), 1.0).otherwise(floor).alias("gain"))


def delay_mask(left: DataFrame, right: DataFrame, rate: float, length: int, threshold: float, floor: float = 0.01) -> DataFrame:
    """Binary mask by the phase difference of two channels: 1 where the time difference it means is at most `threshold` seconds, else floor.
    Bin 0 tells no time and is let through."""
    j = left.alias("l").join(right.alias("r"), ["frame", "bin"])
    re = F.col("l.re") * F.col("r.re") + F.col("l.im") * F.col("r.im")
    im = F.col("l.im") * F.col("r.re") - F.col("l.re") * F.col("r.im")
    time = F.abs(F.atan2(im, re)) * length / (2 * np.pi * rate)
    return j.select("frame", "bin", F.when((F.col("bin") == 0) | (time <= threshold * F.col("bin")), 1.0).otherwise(floor).alias("gain"))


def mask_threshold(left: DataFrame, right: DataFrame, rate: float, length: int, candidates: list[float], power: float = 1 / 15) -> float:
    """The time-difference threshold of `candidates` for which the compressed energies of what the mask keeps and of what it drops
    are least correlated over frames (Kim et al., 2009)."""
    best, least = candidates[0], np.inf
    j = left.withColumn("e", F.col("re") * F.col("re") + F.col("im") * F.col("im")).select("frame", "bin", "e")
    for c in candidates:
        mask = delay_mask(left, right, rate, length, c, 0.0)
        each = j.join(mask, ["frame", "bin"]).groupBy("frame").agg(F.pow(F.sum(F.col("e") * F.col("gain")), F.lit(power)).alias("a"), F.pow(F.sum(F.col("e") * (1 - F.col("gain"))), F.lit(power)).alias("b"))
        r = each.agg(F.corr("a", "b")).first()[0]
        if r is not None and abs(r) < least:
            best, least = c, abs(r)
    return best


def noise_coherence(noise: DataFrame) -> dict[int, np.ndarray]:
    """Coherence matrix of each bin from snapshot vectors of noise, for the post-filters: a model of bins x channels squared."""

    def run(rows: dict) -> np.ndarray:
        x = complex_of(rows)
        r = (x.T @ x.conj()).ravel()
        return np.concatenate([r.real, r.imag])

    out = {}
    for row in sums(noise.select("bin", "re", "im"), ["bin"], run).collect():
        s = np.array(row["s"])
        n = round(np.sqrt(len(s) / 2))
        r = (s[: n * n] + 1j * s[n * n :]).reshape(n, n)
        d = np.sqrt(np.maximum(np.diag(r).real, 1e-300))
        out[row["bin"]] = r / np.outer(d, d)
    return out
