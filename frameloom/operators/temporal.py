"""Operators along time: streams are rows (key, n, ...) ordered by n within a key; joins and windows are on these columns.

Windows are partitioned by the stream's key, so they scale with the number of streams; recursions
walk a stream in order and carry only their state from batch to batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batch import scan


def ordered(key: str, n: str = "n"):
    return Window.partitionBy(key).orderBy(n)


def preemphasis(df: DataFrame, key: str, mu: float = 0.95) -> DataFrame:
    """x[n] - mu * x[n - 1], with 0 before the start."""
    return df.withColumn("y", F.col("x") - mu * F.lag("x", 1, 0.0).over(ordered(key)))


def fir(df: DataFrame, key: str, taps: list[float]) -> DataFrame:
    """Symmetric filter along time: sum over i from -h to h of taps[i + h] * x[n - i], for an odd number 2h + 1 of taps; x is a
    number or a vector, filtered element by element. Before the start and after the end there are zeros."""
    h = len(taps) // 2
    if len(taps) != 2 * h + 1:
        raise ValueError("the number of taps must be odd")
    w = ordered(key)
    from .batch import is_vector

    value = "v" if "v" in df.columns and is_vector(df, "v") else "x"
    near = [(c, F.lag(value, k - h).over(w) if k >= h else F.lead(value, h - k).over(w)) for k, c in enumerate(taps)]
    if value == "x":
        return df.withColumn("y", sum((c * F.coalesce(x, F.lit(0.0)) for c, x in near), F.lit(0.0)))
    out = df
    for k, (_, x) in enumerate(near):
        out = out.withColumn(f"__{k}", x)
    total = F.transform("v", lambda _, i: sum((c * F.coalesce(F.get(F.col(f"__{k}"), i), F.lit(0.0)) for k, (c, _) in enumerate(near)), F.lit(0.0)))
    return out.withColumn("v", total).drop(*(f"__{k}" for k in range(len(near))))


def delta(df: DataFrame, key: str, width: int = 2) -> DataFrame:
    """Regression slope over 2 * width + 1 values; the ends repeat their value."""
    w = ordered(key)
    first, last = F.first("x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gain = 2 * sum(k * k for k in range(1, width + 1))
    terms = (k * (F.coalesce(F.lead("x", k).over(w), last) - F.coalesce(F.lag("x", k).over(w), first)) for k in range(1, width + 1))
    return df.withColumn("y", sum(terms, F.lit(0.0)) / gain)


def frames(df: DataFrame, key: str, length: int, shift: int, pad: bool = False) -> DataFrame:
    """Frames of `length` samples every `shift`: (key, frame_x, v). An incomplete last frame is dropped, or filled with zeros.

    A sample goes to each frame it is part of, so a stream is never gathered whole."""
    first = F.greatest(F.floor((F.col("n") - length) / shift) + 1, F.lit(0))
    each = df.select(key, "n", "x", F.explode(F.sequence(first, F.floor(F.col("n") / shift))).alias("frame_x"))
    each = each.withColumn("k", F.col("n") - F.col("frame_x") * shift).where(F.col("k") < length)
    out = each.groupBy(key, "frame_x").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s"))
    if pad:
        whole = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.get(F.col("s"), i)["x"], F.lit(0.0)))
        return out.select(key, "frame_x", whole.alias("v"))
    return out.where(F.size("s") == length).select(key, "frame_x", F.transform("s", lambda s: s["x"]).alias("v"))


def stack(df: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """Concatenates the vectors from n - before to n + after; beyond the ends of a stream its first and last vector repeat."""
    w = ordered(key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda k: F.coalesce(F.lag("v", -k).over(w), F.first("v").over(whole)) if k < 0 else F.coalesce(F.lead("v", k).over(w), F.last("v").over(whole)) if k else F.col("v")
    near = [at(k) for k in range(-before, after + 1)]
    return df.withColumn("__l", F.concat(*near)).withColumn("v", F.col("__l")).drop("__l")


#: Variances below this count as this.
VARIANCE_FLOOR = 1e-4


def mean_normalised(df: DataFrame, key: str, variance: bool = True) -> DataFrame:
    """Mean and, if asked for, variance normalisation of x over the stream, with a floor of 1e-4 under the variance."""
    w = Window.partitionBy(key)
    y = F.col("x") - F.avg("x").over(w)
    return df.withColumn("y", y / F.sqrt(F.greatest(F.var_pop("x").over(w), F.lit(VARIANCE_FLOOR))) if variance else y)


def range_normalised(df: DataFrame, key: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    w = Window.partitionBy(key)
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    return df.withColumn("y", F.when(hi > lo, (F.col("x") - lo) * (high - low) / (hi - lo) + low).otherwise(F.lit(float(low))))


def adaptive_log(df: DataFrame, key: str, m: float = 1.0, a: float = 4.0) -> DataFrame:
    """m * log10(x + max / 10^a), the maximum being that of the stream; an argument that isn't positive counts as 1."""
    arg = F.col("x") + F.max("x").over(Window.partitionBy(key)) / 10.0**a
    return df.withColumn("y", m * F.log10(F.when(arg > 0, arg).otherwise(1.0)))


class _Fold:
    """Folds numbers in order: y = finish(state) after state = step(state, x)."""

    def __init__(self, start: float, step, finish):
        self.state, self.next, self.finish = start, step, finish

    def step(self, rows: dict) -> dict:
        out = []
        for x in rows["x"].tolist():
            self.state = self.next(self.state, x)
            out.append(self.finish(self.state))
        return {"y": np.array(out, float)}


def recursion(df: DataFrame, key: str, start: float, step, finish=None) -> DataFrame:
    """Folds a stream in order of n: state = step(state, x); returns (key, n, y) with y = finish(state) after each sample.

    For recursions that no window expresses, on plain numbers. Samples come in batches and only the state is carried on."""
    return scan(df.select(key, "n", "x"), [key], ["n"], lambda: _Fold(start, step, finish or (lambda s: s)), "y double", keep=["n"])


class _Exponential:
    """y[n] = alpha * y[n - 1] + (1 - alpha) * x[n] by blocks: within a block a product with powers of alpha, then the carry."""

    BLOCK = 256

    def __init__(self, alpha: float):
        self.last = 0.0
        k = np.arange(self.BLOCK)
        self.matrix = np.where(k[:, None] >= k, alpha ** np.maximum(k[:, None] - k, 0).astype(float), 0.0) * (1 - alpha)
        self.carry = alpha ** (k + 1.0)

    def step(self, rows: dict) -> dict:
        out = []
        for lo in range(0, len(rows["x"]), self.BLOCK):
            x = rows["x"][lo : lo + self.BLOCK]
            y = self.matrix[: len(x), : len(x)] @ x + self.carry[: len(x)] * self.last
            self.last = float(y[-1])
            out.append(y)
        return {"y": np.concatenate(out)}


def exponential_mean(df: DataFrame, key: str, alpha: float) -> DataFrame:
    """y[n] = alpha * y[n - 1] + (1 - alpha) * x[n], from 0: (key, n, y). A stream passes in order, in blocks, with its last mean."""
    return scan(df.select(key, "n", "x"), [key], ["n"], lambda: _Exponential(alpha), "y double", keep=["n"])


def running_mean(df: DataFrame, key: str) -> DataFrame:
    """Mean of all values up to n."""
    return df.withColumn("y", F.avg("x").over(ordered(key).rowsBetween(Window.unboundedPreceding, 0)))


def merge(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Concatenates the vectors of two streams at equal places."""
    return left.join(right.withColumnRenamed("v", "__w"), on).withColumn("v", F.concat("v", "__w")).drop("__w")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each row of left with the last `value` of right at or before its time: union and a window, one shuffle, no range join."""
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__l", F.lit(1))
    other = right.select(*(F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(value).alias("__v"), F.lit(0).alias("__l"))
    w = Window.partitionBy(key).orderBy(time, "__l").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(other).withColumn("held", F.last("__v", ignorenulls=True).over(w)).where("__l = 1").drop("__l", "__v")


def mix(signal: DataFrame, noise: DataFrame, on: list[str], db: float) -> DataFrame:
    """signal + 10^(dB / 20) * noise at equal places."""
    return signal.join(noise.withColumnRenamed("x", "__x"), on).withColumn("y", F.col("x") + 10.0 ** (db / 20) * F.col("__x")).drop("__x")


def cross_correlation(left: DataFrame, right: DataFrame, lags: int, by: list[str] | None = None) -> DataFrame:
    """Sum over n of left[n] * right[n + lag] for lags from -lags to lags, per value of the columns by: an equi-join on shifted places."""
    by = by or []
    shifted = left.select(*by, F.col("x").alias("a"), F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), F.col("n").alias("m")).withColumn("n", F.col("m") + F.col("lag"))
    return shifted.join(right.select(*by, "n", F.col("x").alias("b")), [*by, "n"]).groupBy(*by, "lag").agg(F.sum(F.col("a") * F.col("b")).alias("r"))


def hang_over(df: DataFrame, key: str, frames_on: int, frames_off: int) -> DataFrame:
    """Speech decision with hang-over from raw decisions `hit`: on once `frames_on` hits are in a row, off once `frames_off` misses are."""
    w = ordered(key)
    on = F.min(F.col("hit").cast("int")).over(w.rowsBetween(1 - frames_on, 0)) * (F.count("*").over(w.rowsBetween(1 - frames_on, 0)) == frames_on).cast("int")
    off = (1 - F.max(F.col("hit").cast("int")).over(w.rowsBetween(1 - frames_off, 0))) * (F.count("*").over(w.rowsBetween(1 - frames_off, 0)) == frames_off).cast("int")
    change = F.when(on == 1, 1).when(off == 1, 0)
    return df.withColumn("__c", change).withColumn("speech", F.coalesce(F.last("__c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("__c")


def segments(df: DataFrame, key: str, flag: str = "speech") -> DataFrame:
    """Runs of rows whose flag is set: (key, first, last, size)."""
    w = ordered(key)
    marked = df.withColumn("__g", F.sum((F.col(flag) != F.lag(flag, 1, 0).over(w)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(F.col(flag) == 1).groupBy(key, "__g").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("size")).drop("__g")
