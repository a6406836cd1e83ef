"""Detection and quality measures, and distances of symbol sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snr(df: DataFrame, key: str, clean: str, noisy: str) -> DataFrame:
    """10 log10 of the power of the clean signal over that of the difference, per stream; null where the signals don't differ."""
    d = F.col(noisy) - F.col(clean)
    return df.groupBy(key).agg((10 * F.log10(F.sum(F.col(clean) * F.col(clean)) / F.nullif(F.sum(d * d), F.lit(0.0)))).alias("snr"))


def segmental_snr(df: DataFrame, key: str, clean: str, noisy: str, length: int, low: float = -10.0, high: float = 35.0) -> DataFrame:
    """Mean over segments of `length` samples of the segment's ratio in dB, limited to low..high; a segment without a difference counts as high."""
    d = F.col(noisy) - F.col(clean)
    each = df.groupBy(key, F.floor(F.col("n") / length).alias("segment")).agg((10 * F.log10(F.sum(F.col(clean) * F.col(clean)) / F.nullif(F.sum(d * d), F.lit(0.0)))).alias("snr"), F.sum(d * d).alias("gap"))
    each = each.withColumn("snr", F.when(F.col("gap") == 0, high).otherwise(F.coalesce("snr", F.lit(low))))
    return each.groupBy(key).agg(F.avg(F.greatest(F.lit(low), F.least(F.lit(high), F.col("snr")))).alias("snr"))


def itakura_saito(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Mean of a / b - ln(a / b) - 1 over positive powers."""
    q = F.col(a) / F.col(b)
    return df.where((F.col(a) > 0) & (F.col(b) > 0)).groupBy(key).agg(F.avg(q - F.log(q) - 1).alias("distance"))


def detection(df: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """Hits, misses, false alarms and correct rejections at each threshold, in one pass over the data."""
    each = df.select(F.col(truth).alias("t"), F.col(score).alias("s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    on, yes = F.col("s") >= F.col("threshold"), F.col("t") == 1
    return each.groupBy("threshold").agg(*(F.count_if(c).alias(n) for n, c in (("hits", on & yes), ("misses", ~on & yes), ("false_alarms", on & ~yes), ("rejections", ~on & ~yes))))


def word_errors(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Edit distance in words of two texts, as column `errors`, by folding rows of the distance table: no character tricks, no Python."""
    ref, hyp = F.split(F.col(reference), " "), F.split(F.col(hypothesis), " ")

    def row(previous, word):
        def cell(acc, k):
            value = F.least(F.get(previous, k + 1) + 1, F.element_at(acc, -1) + 1, F.get(previous, k) + F.when(hyp[k] == word, 0).otherwise(1))
            return F.concat(acc, F.array(value))

        return F.aggregate(F.sequence(F.lit(0), F.size(hyp) - 1), F.array(previous[0] + 1), cell)

    return df.withColumn("errors", F.element_at(F.aggregate(ref, F.sequence(F.lit(0), F.size(hyp)), row), -1))
