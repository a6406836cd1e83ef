"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; one of our own only for local masters, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/frameloom"
    return named.rstrip("/")


#: Folder of each kept table, by the table's DataFrame, and all folders that are still there.
_KEPT: set[str] = set()


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes df once: a Parquet table in the shared folder, read again. Its lineage ends there, so a lost executor costs
    tasks of the last step alone; later readers take only the columns they need, and Spark knows the table's size in bytes."""
    spark = df.sparkSession
    path = scratch_path(spark, "kept")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    _KEPT.add(path)
    return out


def small_side(table: DataFrame, columns: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """`columns`, taken from a kept table, for a broadcast if the table's files hold at most `most_bytes`; else as it is, for a shuffled join."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table._kept_at)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(columns) if size <= most_bytes else columns


def forget(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._kept_at)


def forget_all(spark: SparkSession) -> None:
    """Deletes every table that was kept, once no result of the corpus operators is read any more."""
    for path in list(_KEPT):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _KEPT.discard(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Limits the rows of an Arrow batch in this session, as whole texts travel in them: both the JVM and Python hold some at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def row_slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most `most` bytes and 65536 rows, one row at least."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        before = ends[lo - 1] if lo else 0
        hi = min(lo + 65536, max(lo + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield lo, hi
        lo = hi


def text_array(column: pa.Array) -> pa.Array:
    """A string column without nulls (null: empty) and with 64-bit offsets."""
    return column.cast(pa.large_string()).fill_null("")


def text_slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """Runs of whole texts of about `most` bytes: bounded memory whatever the batch holds."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi in row_slices(lengths, most):
        yield lo, hi, text_array(column.slice(lo, hi - lo))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back when its task ends, as Python workers live on."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
