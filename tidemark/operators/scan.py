"""Ordered reads of a visible view (one row a key): seeks, neighbours, ranges, merges.

Seeks are a pushed range filter and a top-k, never a full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import sorted_ranges
from tidemark.operators.versions import merged


def seek(view: DataFrame, target, n: int = 1) -> DataFrame:
    """The first n keys at or after the target."""
    return view.where(F.col("key") >= target).orderBy("key").limit(n)


def first(view: DataFrame, n: int = 1) -> DataFrame:
    return view.orderBy("key").limit(n)


def last(view: DataFrame, n: int = 1) -> DataFrame:
    return view.orderBy(F.desc("key")).limit(n)


def following(view: DataFrame, key, n: int = 1) -> DataFrame:
    """The next n keys, strictly after."""
    return view.where(F.col("key") > key).orderBy("key").limit(n)


def preceding(view: DataFrame, key, n: int = 1) -> DataFrame:
    """The n keys strictly before, nearest first."""
    return view.where(F.col("key") < key).orderBy(F.desc("key")).limit(n)


def range_scan(view: DataFrame, start=None, end=None) -> DataFrame:
    """Keys in the closed range; None is open."""
    if start is not None:
        view = view.where(F.col("key") >= start)
    return view if end is None else view.where(F.col("key") <= end)


def neighbours(view: DataFrame) -> DataFrame:
    """(key, prev_key, next_key) for every key.

    Ranges are sorted apart; a range's outer neighbours are its border rows' in a table of
    one row a range, so the one window without a key sees ranges, not keys.
    """
    ranged = sorted_ranges(view.select("key"), "key", "neighbours")
    inside = Window.partitionBy("_range").orderBy("_row")
    rows = ranged.select("key", "_range", F.lag("key").over(inside).alias("prev_key"), F.lead("key").over(inside).alias("next_key"))
    ends = ranged.groupBy("_range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    along = Window.orderBy("_range")
    ends = ends.select("_range", F.lag("high").over(along).alias("_before"), F.lead("low").over(along).alias("_after"))
    return rows.join(F.broadcast(ends), "_range").select("key", F.coalesce("prev_key", "_before").alias("prev_key"), F.coalesce("next_key", "_after").alias("next_key"))


def merge(sources: list[DataFrame]) -> DataFrame:
    """All versions in order of key and seq, equal ones in order of their sources."""
    return merged(sources).orderBy("key", "seq", "source")


def merge_seek(sources: list[DataFrame], target, n: int) -> DataFrame:
    """The first n versions at or after the target, across sources."""
    return merged(sources).where(F.col("key") >= target).orderBy("key", "seq", "source").limit(n)


def merge_before(sources: list[DataFrame], key, n: int = 1) -> DataFrame:
    """The n distinct keys strictly before, across sources."""
    return merged(sources).where(F.col("key") < key).select("key").distinct().orderBy(F.desc("key")).limit(n)
