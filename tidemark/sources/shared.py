"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own.

    Where the setting is absent, a local master gets a temporary folder and any other
    master a folder in the warehouse, which executors see too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.startswith("local"):
            _OWN[app] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        else:
            _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"
    return _OWN[app]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system named, as Spark resolves it, so that Python finds it too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full if "://" in full else full.replace("file:/", "file:///", 1)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{qualified(spark, shared_dir(spark))}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in durable files.

    A lost executor costs only the tasks it ran, the planner knows the table's size, and
    what isn't the same each time it is computed is computed once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
