"""The log as a stream: newest versions kept up to date, and counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import PUT


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def newest_versions(ops: DataFrame) -> DataFrame:
    """A streaming latest: complete or update mode; state is one row a key."""
    newest = ops.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"), F.max_by("value", "seq").alias("value"))
    return newest.where(F.col("kind") == PUT).select("key", "value", "seq")


def writes_by_window(ops: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, puts, deletes) for append mode; rows later than the watermark are dropped."""
    spans = ops.withWatermark(time, late).groupBy(F.window(time, window))
    return spans.agg(F.sum(F.when(F.col("kind") == PUT, 1).otherwise(0)).alias("puts"), F.sum(F.when(F.col("kind") == PUT, 0).otherwise(1)).alias("deletes"))
