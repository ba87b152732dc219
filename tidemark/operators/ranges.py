"""Sorted order over many tasks: rows numbered within ranges, and slices of a column's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stage

#: A row's number within its range is the low bits of monotonically_increasing_id.
_LOW = 33
#: Slices that two tables of ranges are joined by, and rows of the sample for each bound.
SLICES, PER_SLICE = 200, 40


def sorted_ranges(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with `_range` and `_row`, sorted by the column within ranges that ascend with it.

    As many ranges as there are shuffle partitions, fewer where adaptive execution finds them
    small. Written, so every later job sees the same numbers even if df isn't the same each time.
    """
    own = df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_row", F.monotonically_increasing_id())
    rows = stage(own, name)
    return rows.withColumn("_range", F.shiftright("_row", _LOW)).withColumn("_row", F.col("_row").bitwiseAND(F.lit((1 << _LOW) - 1)))


def bounds(df: DataFrame, column: str) -> list:
    """Ascending values that part the column into at most SLICES slices of about equal counts,
    from a sample of bounded size; equality of slices is a matter of speed only."""
    rows = df.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(PER_SLICE * SLICES).collect()
    values = sorted(bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in rows)
    return sorted({values[len(values) * i // SLICES] for i in range(1, SLICES)}) if values else []


def range_of(column: str, limits: list) -> Column:
    """The number of the slice that holds the column, by a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(F.col(column) < F.lit(limits[middle - 1]), tree(low, middle - 1)).otherwise(tree(middle, high))

    return tree(0, len(limits))
