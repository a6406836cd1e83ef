"""Tables kept in the shared folder between steps: Parquet files that outlive lost executors and end a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; one of our own only for local masters, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/frameloom"
    return named.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Computes df once into a table, which is read from then on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    _KEPT.add(path)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table._kept_at)


def forget_all(spark: SparkSession) -> None:
    """Deletes every kept table, once no result is read any more."""
    for path in list(_KEPT):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    _KEPT.discard(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
