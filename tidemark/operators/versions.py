"""Point and as-of reads over a log `ops` (key, seq, kind, value).

A read at snapshot s sees the version with the greatest seq <= s of each key; a deletion
hides the key. Filters stay on the raw columns, so key and seq reach the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import DELETE, PUT
from tidemark.operators.ranges import sorted_ranges

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def newest(ops: DataFrame, *by: str) -> DataFrame:
    """The newest version for each value of the columns `by`.

    Values of fixed width are reduced by hash aggregation with partial sums map-side; others
    by a window whose group limit keeps one row a key before the shuffle. (key, seq) names one
    version; where a log may repeat it, last_written() says which write holds.
    """
    fixed = all(isinstance(ops.schema[c].dataType, _FIXED) for c in ("kind", "value") if not isinstance(ops.schema[c].dataType, T.DecimalType))
    if fixed:
        return ops.groupBy(*by).agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"), F.max_by("value", "seq").alias("value"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seq")))
    return ops.withColumn("_place", place).where("_place = 1").select(*by, "seq", "kind", "value")


def latest(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, value, seq) visible at the snapshot, or at the head."""
    seen = ops if snapshot is None else ops.where(F.col("seq") <= snapshot)
    return newest(seen, "key").where(F.col("kind") == PUT).select("key", "value", "seq")


def get(ops: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """At most one row; none is "not found"."""
    return latest(ops.where(F.col("key") == key), snapshot)


def multi_get(ops: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, value, seq) for each row of keys (key), nulls where it isn't found.

    Only versions of wanted keys are reduced; Spark broadcasts keys if their size allows.
    """
    wanted = ops.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.select("key").join(latest(wanted, snapshot), "key", "left")


def multi_snapshot(ops: DataFrame, snapshots: list[int]) -> DataFrame:
    """(snapshot, key, value, seq): what each snapshot sees, in one pass over the log.

    A version is first reduced to the newest of its stripe between snapshots, so at most one
    row a key and stripe, not a row a version, is dealt to the snapshots that can see it.
    """
    if not snapshots:
        return latest(ops, -1).select(F.lit(0).cast("long").alias("snapshot"), "key", "value", "seq")
    marks = sorted(set(snapshots))
    striped = newest(ops.where(F.col("seq") <= marks[-1]).withColumn("stripe", stripe(F.col("seq"), marks)), "key", "stripe")
    array = F.array(*(F.lit(m).cast("long") for m in marks))
    dealt = striped.withColumn("snapshot", F.explode(F.filter(array, lambda s: s >= F.col("stripe"))))
    return newest(dealt.drop("stripe"), "snapshot", "key").where(F.col("kind") == PUT).select("snapshot", "key", "value", "seq")


def stripe(seq: Column, live: list[int]) -> Column:
    """The least live snapshot that sees seq; 2^62 above all of them."""
    marks = F.array(*(F.lit(s).cast("long") for s in sorted(set(live)))) if live else F.array().cast("array<long>")
    return F.coalesce(F.array_min(F.filter(marks, lambda s: s >= seq)), F.lit(1 << 62).cast("long"))


def versions(ops: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """Every version of a key that the snapshot sees, oldest first."""
    own = ops.where(F.col("key") == key)
    return (own if snapshot is None else own.where(F.col("seq") <= snapshot)).select("key", "seq", "kind", "value").orderBy("seq")


def deleted_keys(ops: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, seq) of keys whose newest version is a deletion."""
    seen = ops if snapshot is None else ops.where(F.col("seq") <= snapshot)
    return newest(seen, "key").where(F.col("kind") == DELETE).select("key", "seq")


def merged(sources: list[DataFrame]) -> DataFrame:
    """Every version of every source with its source's number; equal ones are all kept."""
    return reduce(DataFrame.unionByName, (s.select("key", "seq", "kind", "value", F.lit(i).alias("source")) for i, s in enumerate(sources)))


def collect_garbage(ops: DataFrame, live: list[int], bottom: bool = False) -> DataFrame:
    """The versions that some live snapshot or the head still needs.

    The newest version of each stripe between live snapshots stays. With bottom, when
    nothing older of these keys lies elsewhere, deletions before a key's first put that
    stays go too, and so do keys without any.
    """
    kept = newest(ops.withColumn("_stripe", stripe(F.col("seq"), live)), "key", "_stripe").select("key", "seq", "kind", "value")
    if not bottom:
        return kept
    first_put = F.min(F.when(F.col("kind") == PUT, F.col("seq"))).over(Window.partitionBy("key"))
    return kept.withColumn("_first", first_put).where(F.col("seq") >= F.col("_first")).drop("_first")


def with_sequence(batch: DataFrame, base: int, order: str = "op_index") -> DataFrame:
    """batch with seq = base, base + 1, ... in the order of op_index.

    Rows are numbered within sorted ranges; each range's first number comes from the counts of
    the ranges before, one row a range, so no task holds the whole batch and none is counted twice.
    """
    ranged = sorted_ranges(batch, order, "batch")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(counts), "_range").withColumn("seq", F.lit(base) + F.col("_before") + F.col("_row")).select(*batch.columns, "seq")


def last_written(ops: DataFrame, written: str) -> DataFrame:
    """ops (key, seq, kind, value) without those that a later write of the same (key, seq, kind)
    replaced; the column `written` orders writes. Nothing else about ops needs them unique."""
    place = F.row_number().over(Window.partitionBy("key", "seq", "kind").orderBy(F.desc(written)))
    return ops.withColumn("_place", place).where("_place = 1").select("key", "seq", "kind", "value")


def consecutive(batch: DataFrame, base: int, order: str = "op_index") -> DataFrame:
    """The same for a batch built by calls: a few thousand rows, numbered in one window."""
    return batch.withColumn("seq", F.lit(base).cast("long") + F.row_number().over(Window.orderBy(order)) - 1)
