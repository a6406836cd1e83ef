"""Whole-stream parts of a front end: mean and variance subtraction, delays, cuts and stored frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batch import scan, sums, vectors
from .temporal import VARIANCE_FLOOR, ordered

#: Weights of the old mean in a running mean, before and after this many frames.
BEFORE, AFTER, CHANGE = 0.98, 0.995, 500


def moments(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Weighted mean and variance of each stream's vectors: (key, mean, variance). Streams whose weights add up to zero have mean zero and variance one."""

    def run(rows: dict) -> np.ndarray:
        x = rows["v"]
        w = rows[weight].astype(float) if weight else np.ones(len(x))
        return np.concatenate([[w.sum()], w @ x, w @ x**2])

    s = sums(df.where(F.col("v").isNotNull()).select(key, "v", *([weight] if weight else [])), [key], run)
    n = ((F.size("s") - 1) / 2).cast("int")
    total = F.col("s")[0]
    mean = F.transform(F.slice("s", 2, n), lambda x: F.when(total != 0, x / F.nullif(total, F.lit(0.0))).otherwise(0.0))
    second = F.transform(F.slice("s", n + 2, n), lambda x: F.when(total != 0, x / F.nullif(total, F.lit(0.0))).otherwise(1.0))
    out = s.select(key, mean.alias("mean"), second.alias("second"))
    return out.select(key, "mean", F.zip_with("second", "mean", lambda b, a: b - a * a).alias("variance"))


def subtract(df: DataFrame, moments: DataFrame, key: str, deviation: float = 0.0) -> DataFrame:
    """v less the stream's mean and, if deviation is positive, over deviation times the root of its variance, floored at 1e-4. The table of
    moments has one row per stream; it may come from a file."""
    joined = df.join(moments.select(F.col(key).alias("__k"), "mean", "variance"), F.col(key).eqNullSafe(F.col("__k")))

    def run(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
        y = x - mean
        return y / (deviation * np.sqrt(np.maximum(var, VARIANCE_FLOOR))) if deviation > 0 else y

    return joined.withColumn("v", vectors(run, "array<double>", "v", "mean", "variance")).drop("__k", "mean", "variance")


def subtract_mean(df: DataFrame, key: str, weight: str | None = None, deviation: float = 0.0) -> DataFrame:
    return subtract(df, moments(df, key, weight), key, deviation)


class _Running:
    def __init__(self, deviation: float, weight: str | None):
        self.deviation, self.weight, self.frames, self.mean, self.var = deviation, weight, 0, None, None

    def step(self, rows: dict) -> dict:
        out = []
        use = rows[self.weight] > 0 if self.weight else np.ones(len(rows["v"]), bool)
        for x, counts in zip(rows["v"], use, strict=True):
            if self.mean is None:
                self.mean, self.var = np.zeros(len(x)), np.ones(len(x))
            if counts:
                a = BEFORE if self.frames < CHANGE else AFTER
                self.mean = a * self.mean + (1 - a) * x
                if self.deviation > 0:
                    self.var = a * self.var + (1 - a) * (x - self.mean) ** 2
                self.frames += 1
            y = x - self.mean
            out.append(y / (self.deviation * np.sqrt(np.maximum(self.var, VARIANCE_FLOOR))) if self.deviation > 0 else y)
        return {"v": np.array(out)}


def subtract_running_mean(df: DataFrame, key: str, weight: str | None = None, deviation: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """v less a running mean, which a frame with a positive weight moves before it is used; the old mean's weight is 0.98 for 500 frames
    and 0.995 from then on. (key, keep, v), in order of n."""
    keep = keep or ["n"]
    columns = list(dict.fromkeys([key, "n", "v", *keep, *([weight] if weight else [])]))
    return scan(df.select(*columns), [key], ["n"], lambda: _Running(deviation, weight), "v array<double>", keep=keep)


def delay(df: DataFrame, key: str, by: int) -> DataFrame:
    """x `by` samples later, with zeros before, as y. For vectors: the frame of `by` places before, null where there is none."""
    from .batch import is_vector

    if "v" in df.columns and is_vector(df, "v"):
        return df.withColumn("v", F.lag("v", by).over(ordered(key)))
    return df.withColumn("y", F.lag("x", by, 0.0).over(ordered(key)))


def cut(df: DataFrame, key: str, first: int, last: int, zero_mean: bool = False) -> DataFrame:
    """Samples first to last, both included and -1 being the end, counted from 0 anew; with zero_mean less the mean of the whole stream. The filter on places is pushed
    to the scan if no mean is taken."""
    if zero_mean:
        df = df.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(key)))
    kept = df.where((F.col("n") >= first) & ((F.col("n") <= last) if last >= 0 else F.lit(True)))
    return kept.withColumn("n", F.col("n") - first)


def add_noise(df: DataFrame, db: float, key: str, seed: int = 0) -> DataFrame:
    """White noise at db under the stream's power, from a seed, so that it can be made again: the noise of a sample depends on its key and place."""
    power = F.avg(F.col("x") * F.col("x")).over(Window.partitionBy(key))
    u = lambda salt: (F.pmod(F.xxhash64(F.col(key), F.col("n"), F.lit(seed + salt)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    return df.withColumn("x", F.col("x") + F.sqrt(power) * 10 ** (-db / 20) * normal)


def last_frames(df: DataFrame, key: str, frames: int = 3) -> DataFrame:
    """The `frames` last vectors up to each frame, newest first: `past`, for operators that look back."""
    w = ordered(key).rowsBetween(1 - frames, 0)
    return df.withColumn("past", F.reverse(F.collect_list("v").over(w)))


def cepstra(samples: DataFrame, key: str, length: int = 320, shift: int = 160, fft_length: int = 512, filters: int = 30, coefficients: int = 13, rate: float = 16000.0, floor: float = 1e-5) -> DataFrame:
    """The usual front end as one plan: pre-emphasis, frames, window, power, mel filters, log and cosine transform: (key, n, v)."""
    from . import frames as fr
    from . import temporal

    emphasised = temporal.preemphasis(samples, key).withColumn("x", F.col("y")).select(key, "n", "x")
    f = fr.hamming(temporal.frames(emphasised, key, length, shift).withColumnRenamed("frame_x", "n"))
    half = fft_length // 2 + 1
    padded = f.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), fft_length - length)))
    mel = fr.sphinx_mel_filterbank(fr.dft_power(padded, half), filters, half, fft_length, rate)
    return fr.cepstrum(fr.log_scale(mel, 1.0, floor=floor), coefficients, filters)


def with_deltas(df: DataFrame, key: str, taps: tuple[float, ...] = (0.2, 0.1, 0.0, -0.1, -0.2)) -> DataFrame:
    """v, its slope and the slope's slope, one after another."""
    from . import temporal

    first = temporal.fir(df, key, list(taps)).withColumnRenamed("v", "__d").select(key, "n", "__d")
    second = temporal.fir(first.withColumnRenamed("__d", "v"), key, list(taps)).withColumnRenamed("v", "__dd").select(key, "n", "__dd")
    return df.join(first, [key, "n"]).join(second, [key, "n"]).withColumn("v", F.concat("v", "__d", "__dd")).drop("__d", "__dd")
