"""Microphone arrays: snapshots are complex frames per channel, as long rows (frame, chan, bin, re, im)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import scan, sums, vectors


def spectra(frames: DataFrame, keys: list[str], bins: int, length: int) -> DataFrame:
    """Discrete Fourier transform of frames `v` (cut or filled to `length`) as long rows (keys, bin, re, im) of the first `bins` bins.

    Parts within the rounding of the frame's sum are 0, so that a bin without power has none, rather than the phase of an error."""

    def run(x: np.ndarray) -> dict:
        x = x[:, :length].astype(float)
        z = np.fft.fft(x, length, axis=1)[:, :bins]
        error = np.finfo(float).eps * (1 + math.log2(length)) * np.abs(x).sum(1, keepdims=True)
        return {"re": np.where(np.abs(z.real) < error, 0.0, z.real), "im": np.where(np.abs(z.imag) < error, 0.0, z.imag)}

    z = frames.select(*keys, vectors(run, "re array<double>, im array<double>", "v").alias("z"))
    z = z.select(*keys, F.posexplode(F.arrays_zip(F.col("z.re").alias("re"), F.col("z.im").alias("im"))).alias("bin", "z"))
    return z.select(*keys, "bin", "z.re", "z.im")


def delay_and_sum(snapshots: DataFrame, delays: dict[int, float], rate: float, length: int) -> DataFrame:
    """Mean over channels of the snapshot with each channel's delay (seconds) taken out; the delays are a literal map."""
    table = F.create_map(*(F.lit(x) for kv in delays.items() for x in kv))
    turn = F.col("bin") * (2 * math.pi * rate / length) * table[F.col("chan")]
    re, im = F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn), F.col("re") * F.sin(turn) + F.col("im") * F.cos(turn)
    return snapshots.groupBy("frame", "bin").agg(F.avg(re).alias("re"), F.avg(im).alias("im"))


def snapshot_vectors(snapshots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per frame and bin with the channels' values as vectors `re` and `im`, in the order of `chan` (arrays have few channels)."""
    keys = keys or ["frame", "bin"]
    out = snapshots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chan", "re", "im"))).alias("z"))
    return out.select(*keys, F.transform("z", lambda z: z["re"]).alias("re"), F.transform("z", lambda z: z["im"]).alias("im"))


def complex_of(rows: dict) -> np.ndarray:
    return rows["re"] + 1j * rows["im"]


def cross_spectra(snapshots: DataFrame) -> DataFrame:
    """Mean over frames of x_a * conj(x_b) for channel pairs a <= b: (a, b, bin, re, im). All channels take part in all frames."""
    v = snapshot_vectors(snapshots)

    def run(rows: dict) -> np.ndarray:
        x = complex_of(rows)
        r = (x.T @ x.conj()).ravel()
        return np.concatenate([[len(x)], r.real, r.imag])

    s = sums(v.select("bin", "re", "im"), ["bin"], run)
    n = F.sqrt((F.size("s") - 1) / 2).cast("int")
    pairs = s.select("bin", "s", n.alias("n"), F.explode(F.sequence(F.lit(0), (n * n - 1).cast("int"))).alias("k"))
    a, b = F.floor(F.col("k") / F.col("n")).cast("long"), (F.col("k") % F.col("n")).cast("long")
    re, im = F.get("s", F.col("k") + 1), F.get("s", F.col("k") + 1 + F.col("n") * F.col("n"))
    return pairs.select(a.alias("a"), b.alias("b"), "bin", (re / F.col("s")[0]).alias("re"), (im / F.col("s")[0]).alias("im")).where("a <= b")


class _Nlms:
    def __init__(self, taps: int, step: float, delta: float):
        self.w, self.u, self.rate, self.delta = np.zeros(taps), np.zeros(taps), step, delta

    def step(self, rows: dict) -> dict:
        e = np.empty(len(rows["x"]))
        for k, (x, far) in enumerate(zip(rows["x"], rows["far"], strict=True)):
            self.u = np.concatenate([[far], self.u[:-1]])
            e[k] = x - self.w @ self.u
            self.w = self.w + self.rate * e[k] * self.u / (self.delta + self.u @ self.u)
        return {"e": e}


def echo_canceller(df: DataFrame, key: str, taps: int = 4, step: float = 0.5, delta: float = 1e-3) -> DataFrame:
    """Normalised LMS: predicts `x` from the last `taps` values of `far` and returns (key, n, e) with the error left. A stream
    passes in order, batch by batch, with the filter as its state."""
    return scan(df.select(key, "n", "x", "far"), [key], ["n"], lambda: _Nlms(taps, step, delta), "e double", keep=["n"])
