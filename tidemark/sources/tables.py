"""Operation logs and file lists over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ops(spark: SparkSession, sf_dir: str, snapshot: int | None = None) -> DataFrame:
    """events as a log: user_id is the key, event_id + 1 the seq, an error a deletion.

    A snapshot is a filter on the raw event_id, which reaches the Parquet scan.
    """
    events = read(spark, sf_dir, "events")
    if snapshot is not None:
        events = events.where(F.col("event_id") <= snapshot - 1)
    kind = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return events.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), kind.alias("kind"), "value")


def text_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with key and value as bytes of their text, as a store or log file holds them."""
    text = lambda c: F.col(c).cast("string").cast("binary")
    return event_ops(spark, sf_dir).select(text("key").alias("key"), "seq", "kind", text("value").alias("value"))


def order_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a log: o_custkey is the key, o_orderkey + 1 the seq, status F a deletion."""
    kind = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") + 1).alias("seq"), kind.alias("kind"), F.col("o_totalprice").alias("value"))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 500 events as files, dealt over seven levels; 100 bytes an event."""
    run = F.floor(F.col("event_id") / 500).cast("long")
    sums = read(spark, sf_dir, "events").groupBy(run.alias("run")).agg(F.count("*").alias("n"), F.min("user_id").alias("smallest"), F.max("user_id").alias("largest"))
    return sums.select((F.col("run") + 1).alias("file_number"), (F.col("run") % 7).alias("level"), (F.col("n") * 100).alias("size"), "smallest", "largest")
