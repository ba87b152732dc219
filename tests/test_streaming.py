"""The log as a stream gives what the batch queries give."""

from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.streaming import tail

SCHEMA = "key long, seq long, kind int, value double"


def test_stream_equals_batch(spark, tmp_path):
    ops = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("kind"), "value")
    ops.repartition(3).write.parquet(f"{tmp_path}/log")
    stream = tail.newest_versions(tail.read_log(spark, f"{tmp_path}/log", SCHEMA, files_per_trigger=1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("newest").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("newest").collect())) == sorted(map(tuple, versions.latest(ops).collect()))


def test_windows(spark, tmp_path):
    spark.range(6).select(F.timestamp_seconds(F.col("id") * 1800).alias("ts"), (F.col("id") % 2).cast("int").alias("kind")).write.parquet(f"{tmp_path}/log")
    q = tail.writes_by_window(tail.read_log(spark, f"{tmp_path}/log", "ts timestamp, kind int")).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.puts, r.deletes) for r in spark.table("windows").collect()] == [(1, 1), (1, 1)]
