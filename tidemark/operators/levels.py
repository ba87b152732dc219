"""Files and levels: overlap, targets, compaction planning, statistics.

files: (level, file_number, size, smallest, largest); null bounds match everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import sizing
from tidemark.operators.ranges import bounds, range_of


def overlaps(smallest: Column, largest: Column, start: Column, end: Column) -> Column:
    """Do two closed ranges meet? A null bound is open."""
    return (smallest.isNull() | end.isNull() | (smallest <= end)) & (largest.isNull() | start.isNull() | (largest >= start))


#: Bytes up to which one side of a range join is sent to every task, and compared row by row.
SMALL_BYTES = 1 << 20


def broadcast_if_small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame | None:
    """df marked for broadcast if its rows have at most so many bytes, else None.

    Counted, since the planner's estimate may come from compressed files: 16 bytes a column
    and the bytes of strings, over one row more than could fit at most.
    """
    rows = most // (16 * len(df.columns))
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    held = df.limit(rows + 1).agg(F.count("*"), F.sum(sum(wide, F.lit(16 * len(df.columns))))).first()
    return F.broadcast(df) if held[0] <= rows and (held[1] or 0) <= most else None


def near_ranges(keys: DataFrame, files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_number, key, *keep): each of the distinct keys (key) with the files whose closed range
    (smallest, largest, nulls open) holds it; keep names other columns of either side. Few files
    are broadcast, and the keys dealt out again, since few bytes of keys can be many pairs; many
    files are dealt out by the slices of the key space that they meet, so no side is repeated to
    all tasks."""
    ranges = files.select("file_number", "smallest", "largest", *(c for c in keep if c in files.columns))
    within = overlaps(F.col("smallest"), F.col("largest"), F.col("key"), F.col("key")) & F.col("key").isNotNull()
    small = broadcast_if_small(ranges)
    if small is None:
        return sliced_join(keys, ranges, within, keep)
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = keys.repartition(tasks, F.xxhash64("key"))  # by the key itself, Spark would leave out what distinct() dealt out already
    return spread.join(small, within).select("file_number", "key", *keep)


def sliced_join(keys: DataFrame, ranges: DataFrame, within: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same by slices: a key lies in one slice, a range in all that it meets. Keys beyond all
    ranges are left out first, so the slices part those that can be met."""
    ends = ranges.agg(F.min("smallest"), F.max("largest"), F.count_if(F.col("smallest").isNull()), F.count_if(F.col("largest").isNull())).first()
    low, high = (bytes(x) if isinstance(x, bytearray) else x for x in ends[:2])
    if low is not None and not ends[2]:
        keys = keys.where(F.col("key") >= F.lit(low))
    if high is not None and not ends[3]:
        keys = keys.where(F.col("key") <= F.lit(high))
    limits = bounds(keys, "key")
    first = F.when(F.col("smallest").isNull(), 0).otherwise(range_of("smallest", limits))
    last = F.when(F.col("largest").isNull(), len(limits)).otherwise(range_of("largest", limits))
    met = ranges.withColumn("_slice", F.explode(F.sequence(first, F.greatest(first, last))))
    return keys.withColumn("_slice", range_of("key", limits)).join(met.hint("merge"), "_slice").where(within).select("file_number", "key", *keep)


def files_in_range(files: DataFrame, level: int | None = None, start=None, end=None) -> DataFrame:
    own = files if level is None else files.where(F.col("level") == level)
    kind = files.schema["smallest"].dataType
    return own.where(overlaps(F.col("smallest"), F.col("largest"), F.lit(start).cast(kind), F.lit(end).cast(kind)))


def files_for_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, file_number) for each of a stated set of ranges (range_id, start_key, end_key).

    A small side is broadcast. Otherwise both are dealt out by the slices of the key space that
    they meet, and a pair is reported in the first slice that both meet.
    """
    hit = overlaps(F.col("smallest"), F.col("largest"), F.col("start_key"), F.col("end_key"))
    asked, own = ranges.select("range_id", "start_key", "end_key"), files.select("file_number", "smallest", "largest")
    small = broadcast_if_small(asked)
    if small is not None:
        return own.join(small, hit).select("range_id", "file_number")
    small = broadcast_if_small(own)
    if small is not None:
        return asked.join(small, hit).select("range_id", "file_number")
    limits = bounds(own.withColumnRenamed("smallest", "key"), "key")
    spread = lambda df, a, b: df.withColumn("_from", F.when(F.col(a).isNull(), 0).otherwise(range_of(a, limits))).withColumn("_slice", F.explode(F.sequence("_from", F.greatest(F.col("_from"), F.when(F.col(b).isNull(), len(limits)).otherwise(range_of(b, limits))))))
    a, b = spread(own, "smallest", "largest"), spread(asked, "start_key", "end_key").withColumnRenamed("_from", "_start")
    return a.join(b.hint("merge"), "_slice").where(hit & (F.col("_slice") == F.greatest("_from", "_start"))).select("range_id", "file_number")


def key_range(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("entries"))


def all_levels(spark: SparkSession, n: int = sizing.MAX_LEVELS) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("level"))


def level_stats(files: DataFrame, n: int = sizing.MAX_LEVELS, write_buffer: int = sizing.WRITE_BUFFER, trigger: int = sizing.L0_TRIGGER, multiplier: int = sizing.LEVEL_MULTIPLIER) -> DataFrame:
    """(level, file_count, total_size, target_size, needs_compaction), empty levels too."""
    sums = files.groupBy(F.col("level").cast("int").alias("level")).agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"))
    rows = all_levels(files.sparkSession, n).join(sums, "level", "left").fillna(0, ["file_count", "total_size"])
    rows = rows.withColumn("target_size", sizing.level_target(F.col("level"), write_buffer, multiplier))
    full = F.when(F.col("level") == 0, F.col("file_count") >= trigger).otherwise(F.col("total_size") > F.col("target_size"))
    return rows.withColumn("needs_compaction", full)


def needs_compaction(files: DataFrame, **options) -> DataFrame:
    return level_stats(files, **options).agg(F.max("needs_compaction").alias("needed"))


def select_files(files: DataFrame, level: int, target: int) -> DataFrame:
    """Files to compact: all of level 0; deeper, the longest prefix within half the target."""
    own = files.where(F.col("level") == level)
    if level == 0:
        return own.select("file_number")
    running = F.sum("size").over(Window.partitionBy("level").orderBy("file_number").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_sum", running).where(F.col("_sum") <= target // 2).select("file_number")


def remove_files(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(gone.select("file_number"), "file_number", "left_anti")


def priorities(files: DataFrame, target: int, hours: float) -> DataFrame:
    """(level, priority, mode) by files, size and hours since the last compaction."""
    sums = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    p = sizing.compaction_priority(F.col("level"), F.col("n"), F.col("size"), F.lit(target), F.lit(hours))
    return sums.select("level", F.round(p, 6).alias("priority")).withColumn("mode", sizing.compaction_mode(F.col("priority")))


def oldest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(F.col("ref_count") > 0).agg(F.coalesce(F.min("seq"), F.lit(0)).cast("long").alias("oldest"))
