"""Resumable ingest by chunk, and tables that are built once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import optional


def finished(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """Keys of the chunks that are in, one row each."""
    return optional(spark, f"{path}/done", f"{key} {kind}, batch string", lambda s, p: s.read.schema(f"{key} {kind}, batch string").parquet(p))


def ingest(chunks: DataFrame, read: Callable[[DataFrame], DataFrame], path: str, key: str) -> int:
    """Read the chunks (column `key`) that are not in yet, by `read(chunks)`, into `path`; the number of chunks read.

    The rows go into a folder of their own first and count only once their keys are marked as finished, so a run that breaks
    off leaves nothing behind that the next one would read twice.
    """
    spark = chunks.sparkSession
    kind = chunks.schema[key].dataType.simpleString()
    todo = chunks.select(key).distinct().join(finished(spark, path, key, kind).select(key), key, "left_anti")
    batch = uuid.uuid4().hex
    todo.withColumn("batch", F.lit(batch)).write.parquet(f"{path}/asked/batch={batch}")
    asked = spark.read.parquet(f"{path}/asked/batch={batch}")
    n = asked.count()
    if n:
        read(asked.select(key)).write.parquet(f"{path}/rows/batch={batch}")
        asked.select(key, F.lit(batch).alias("batch")).write.mode("append").parquet(f"{path}/done")
    return n


def rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the finished batches."""
    done = spark.read.parquet(f"{path}/done").select("batch").distinct()
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").join(F.broadcast(done), "batch", "left_semi").drop("batch")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, which is built and written first if it is not there."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
