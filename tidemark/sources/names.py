"""Names of log and table files: the next number, and which old logs may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT_LOGS = 5


def numbered(names: DataFrame, column: str = "name") -> DataFrame:
    """names with number: that of `LOG.<n>` or `<n>.log`, null for other names."""
    digits = F.coalesce(F.nullif(F.regexp_extract(column, r"^LOG\.(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(column, r"^(\d+)\.log$", 1), F.lit("")))
    return names.withColumn("number", digits.cast("long"))


def next_log(names: DataFrame) -> DataFrame:
    return numbered(names).agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next_log"))


def removable_logs(names: DataFrame, keep: int = KEPT_LOGS) -> DataFrame:
    """Logs but for the `keep` highest-numbered ones; one row a file, so one window will do."""
    place = F.row_number().over(Window.orderBy(F.desc("number")))
    return numbered(names).where("number is not null").withColumn("_place", place).where(F.col("_place") > keep).select("name", "number")


def table_name(number: Column) -> Column:
    """`000042.sst`; longer numbers are not cut."""
    return F.format_string("%06d.sst", number)
