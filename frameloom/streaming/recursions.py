"""Streaming forms: recursions over a stream's samples with state kept per key, and windowed powers with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def exponential_mean(stream: DataFrame, key: str, alpha: float) -> DataFrame:
    """y = alpha * y + (1 - alpha) * x for each sample of a micro-batch, in order of n; equal to the batch operator over all samples."""

    def step(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values("n")
        out = []
        for x in rows["x"]:
            y = alpha * y + (1 - alpha) * x
            out.append(y)
        state.update((y,))
        yield pd.DataFrame({"key": [of[0]] * len(out), "n": rows["n"].to_numpy(), "y": out})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(F.col(key).alias("key"), "n", "x").groupBy("key").applyInPandasWithState(step, f"key {kind}, n long, y double", "y double", "append", GroupStateTimeout.NoTimeout)


def windowed_power(stream: DataFrame, key: str, time: str, width: str, late: str) -> DataFrame:
    """Mean square of x per key and time window; a window is given out once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w")).agg(F.avg(F.col("x") * F.col("x")).alias("power"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "power", "n")
