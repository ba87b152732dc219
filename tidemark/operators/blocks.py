"""Sizes of buffers, and blocks of a sorted file: packing, restarts, index search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESTART_EVERY = 15


def entry_bytes(key: Column, value: Column) -> Column:
    """Bytes of an entry in memory: internal key (key and 8 bytes) and value."""
    return (F.octet_length(key) + 8 + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def memory_usage(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(entry_bytes(key, value)), F.lit(0)).alias("bytes"), F.count("*").alias("entries"))


def buffers(rows: DataFrame, group: str, order: str, key: Column, value: Column, buffer: int) -> DataFrame:
    """rows with the buffer that takes each: the running size within a group, by buffer size."""
    running = F.sum(entry_bytes(key, value)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("buffer", F.floor(running / buffer).cast("long"))


def blocks(rows: DataFrame, per_block: int, file: str = "file_number", key: str = "key") -> DataFrame:
    """rows of sorted files with block and restart numbers, each file apart."""
    place = F.row_number().over(Window.partitionBy(file).orderBy(key)) - 1
    placed = rows.withColumn("_place", place)
    return placed.withColumn("block", F.floor(F.col("_place") / per_block).cast("long")).withColumn("restart", F.floor((F.col("_place") % per_block) / RESTART_EVERY).cast("long")).drop("_place")


def block_index(blocked: DataFrame, file: str = "file_number", key: str = "key") -> DataFrame:
    """(file, block, last_key, entries): the sparse index."""
    return blocked.groupBy(file, "block").agg(F.max(key).alias("last_key"), F.count("*").alias("entries"))


def find_block(index: DataFrame, target, file: str = "file_number") -> DataFrame:
    """The first block of each file whose last key reaches the target."""
    return index.where(F.col("last_key") >= target).groupBy(file).agg(F.min("block").alias("block"))
