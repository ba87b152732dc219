"""What the operators share: the cluster's shared folder, written tables, worker paths."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import fresh_path as fresh_path
from tidemark.sources.shared import qualified as qualified

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of an Arrow batch to or from a Python worker.
BATCH_BYTES = "8m"

#: Paths of the tables staged within each open scratch().
_SCRATCH: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in durable files.

    A lost executor costs only the tasks it ran, the planner knows the table's size, and what
    isn't the same each time it is computed is computed once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged within are deleted at the end, but for what is staged by the function given."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        mine = _SCRATCH.pop()
        try:
            return stage(df, name)
        finally:
            _SCRATCH.append(mine)

    _SCRATCH.append([])
    try:
        yield keep
    finally:
        for path in _SCRATCH.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Within, these settings of the session hold."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def filtered_joins(spark: SparkSession):
    """Within, Spark filters the large side of a shuffled join by a Bloom filter of bounded
    size (spark.sql.optimizer.runtime.bloomFilter.maxNumBits) before it shuffles. The small
    sides grow with the corpus, so they are merged at every size, never broadcast."""
    name = "spark.sql.optimizer.runtime.bloomFilter."
    return settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", name + "enabled": "true", name + "applicationSideScanSizeThreshold": "0", name + "creationSideThreshold": "1g"})


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package even when the driver runs in another folder, and
    keep Arrow batches small: texts are long, and each task holds a batch on either side."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def texts(docs: DataFrame, *extra: str | Column) -> DataFrame:
    """(doc_id, text, extra...) only, so that other columns can't clash; null text is empty."""
    reach_workers(docs.sparkSession)
    return docs.select("doc_id", whole_text().alias("text"), *extra)


def quoted(df: DataFrame) -> list[Column]:
    """df's columns, each by its whole name, dots and all."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(df: DataFrame, column: str, most: int) -> DataFrame:
    """The distinct values of the column whose hashes are least, at most so many.

    Where there are many, those above a bound on the hash, under which twice as many as wanted
    are expected, go first: what is then sorted and merged doesn't grow with df.
    """
    own = df.select(column).where(F.col(column).isNotNull())
    n = own.agg(F.approx_count_distinct(column)).first()[0]
    if n > 4 * most:
        own = own.where(F.xxhash64(column) < -(1 << 63) + (1 << 64) * 2 * most // n)
    return own.distinct().orderBy(F.xxhash64(column), column).limit(most)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def rows_of(batch, *names: str) -> Iterable[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)
