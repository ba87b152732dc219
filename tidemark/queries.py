"""The catalogue: each query over whole driver tables, and the equal DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys, sizing
from tidemark.operators import blocks, bloom, levels, scan, versions
from tidemark.plans.options import Options
from tidemark.plans.store import Store
from tidemark.sources import log_files, names, tables
from tidemark.sources.shared import fresh_path, stage

SNAPSHOT = 2500
SNAPSHOTS = [100, 2500, 5000]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_OPS = "ops AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, value FROM events)"
_ORDERS = "ops AS (SELECT o_custkey AS key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS kind, o_totalprice AS value FROM orders)"
_FILES = "files AS (SELECT event_id // 500 + 1 AS file_number, (event_id // 500) % 7 AS level, CAST(count(*) * 100 AS BIGINT) AS size, min(user_id) AS smallest, max(user_id) AS largest FROM events GROUP BY 1, 2)"


def _latest(snapshot: int | None = None, ops: str = _OPS) -> str:
    seen = "" if snapshot is None else f" WHERE seq <= {snapshot}"
    return f"{ops}, latest AS (SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ops{seen}) q WHERE rn = 1 AND kind = 1)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def view(spark: SparkSession, sf_dir: str, snapshot: int | None = None) -> DataFrame:
    return versions.latest(tables.event_ops(spark, sf_dir, snapshot))


# point and as-of reads


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest")
def kv_latest(spark, sf_dir):
    return view(spark, sf_dir)


@query(f"WITH {_latest(ops=_ORDERS)} SELECT key, value, seq FROM latest")
def kv_latest_orders(spark, sf_dir):
    return versions.latest(tables.order_ops(spark, sf_dir))


@query(f"WITH {_latest(SNAPSHOT)} SELECT key, value, seq FROM latest")
def kv_asof(spark, sf_dir):
    return view(spark, sf_dir, SNAPSHOT)


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest WHERE key = 42")
def kv_get(spark, sf_dir):
    return versions.get(tables.event_ops(spark, sf_dir), 42)


@query(f"WITH {_latest()}, wanted AS (SELECT s_suppkey AS key FROM supplier) SELECT wanted.key, value, seq FROM wanted LEFT JOIN latest USING (key)")
def kv_multi_get(spark, sf_dir):
    wanted = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    return versions.multi_get(tables.event_ops(spark, sf_dir), wanted)


@query(
    f"""WITH {_OPS}, snaps AS (SELECT CAST(s AS BIGINT) AS snapshot FROM (VALUES (100), (2500), (5000)) v(s)),
q AS (SELECT snapshot, ops.*, row_number() OVER (PARTITION BY snapshot, key ORDER BY seq DESC) AS rn FROM snaps JOIN ops ON seq <= snapshot)
SELECT snapshot, key, value, seq FROM q WHERE rn = 1 AND kind = 1"""
)
def kv_multi_snapshot(spark, sf_dir):
    return versions.multi_snapshot(tables.event_ops(spark, sf_dir), SNAPSHOTS)


@query(f"WITH {_OPS} SELECT key, seq, kind, value FROM ops WHERE key = 42")
def kv_versions(spark, sf_dir):
    return versions.versions(tables.event_ops(spark, sf_dir), 42)


@query(f"WITH {_OPS} SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ops) q WHERE rn = 1 AND kind = 0")
def kv_deleted_keys(spark, sf_dir):
    return versions.deleted_keys(tables.event_ops(spark, sf_dir))


# ordered reads


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest WHERE key >= 37 ORDER BY key LIMIT 1")
def kv_seek(spark, sf_dir):
    return scan.seek(view(spark, sf_dir), 37)


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest ORDER BY key LIMIT 1")
def kv_seek_first(spark, sf_dir):
    return scan.first(view(spark, sf_dir))


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest ORDER BY key DESC LIMIT 1")
def kv_seek_last(spark, sf_dir):
    return scan.last(view(spark, sf_dir))


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest WHERE key > 37 ORDER BY key LIMIT 5")
def kv_next_n(spark, sf_dir):
    return scan.following(view(spark, sf_dir), 37, 5)


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest WHERE key < 37 ORDER BY key DESC LIMIT 5")
def kv_prev_n(spark, sf_dir):
    return scan.preceding(view(spark, sf_dir), 37, 5)


@query(f"WITH {_latest()} SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM latest")
def kv_iter_next_prev(spark, sf_dir):
    return scan.neighbours(view(spark, sf_dir))


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest WHERE key BETWEEN 10 AND 40")
def kv_range_scan(spark, sf_dir):
    return scan.range_scan(view(spark, sf_dir), 10, 40)


def _slices(spark, sf_dir) -> list[DataFrame]:
    ops = tables.event_ops(spark, sf_dir)
    return [ops.where(F.col("seq") % 4 == i) for i in range(4)]


@query(f"WITH {_OPS} SELECT key, seq, kind, value, CAST(seq % 4 AS INT) AS source FROM ops ORDER BY key, seq")
def kv_merge(spark, sf_dir):
    return scan.merge(_slices(spark, sf_dir))


@query(f"WITH {_OPS} SELECT key, seq, kind, value, CAST(seq % 4 AS INT) AS source FROM ops WHERE key >= 37 ORDER BY key, seq LIMIT 20")
def kv_merge_seek(spark, sf_dir):
    return scan.merge_seek(_slices(spark, sf_dir), 37, 20)


@query(f"WITH {_OPS} SELECT DISTINCT key FROM ops WHERE key < 37 ORDER BY key DESC LIMIT 3")
def kv_merge_prev(spark, sf_dir):
    return scan.merge_before(_slices(spark, sf_dir), 37, 3)


# writes and recovery


@query("SELECT o_orderkey AS op_index, o_custkey AS key, 1000 + row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders")
def kv_batch_seq(spark, sf_dir):
    batch = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("op_index"), F.col("o_custkey").alias("key"))
    return versions.with_sequence(batch, 1000)


@query(f"WITH {_OPS} SELECT count(*) AS records, max(seq) + 1 AS next_seq, count(*) FILTER (kind = 0) AS deletions FROM ops")
def kv_recover(spark, sf_dir):
    return tables.event_ops(spark, sf_dir).agg(F.count("*").alias("records"), (F.max("seq") + 1).alias("next_seq"), F.count_if(F.col("kind") == 0).alias("deletions"))


def _log_names(spark, sf_dir) -> DataFrame:
    n = F.col("s_suppkey")
    name = F.when(n % 3 == 0, F.concat(F.lit("LOG."), n.cast("string"))).when(n % 3 == 1, F.format_string("%06d.log", n)).otherwise(F.format_string("%06d.sst", n))
    return tables.read(spark, sf_dir, "supplier").select(name.alias("name"))


_NAMES = """names AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'LOG.' || s_suppkey WHEN s_suppkey % 3 = 1 THEN printf('%06d.log', s_suppkey) ELSE printf('%06d.sst', s_suppkey) END AS name FROM supplier),
numbered AS (SELECT name, CAST(coalesce(nullif(regexp_extract(name, '^LOG\\.(\\d+)$', 1), ''), nullif(regexp_extract(name, '^(\\d+)\\.log$', 1), '')) AS BIGINT) AS number FROM names)"""


@query(f"WITH {_NAMES} SELECT coalesce(max(number), 0) + 1 AS next_log FROM numbered")
def kv_next_log(spark, sf_dir):
    return names.next_log(_log_names(spark, sf_dir))


@query(f"WITH {_NAMES} SELECT name, number FROM (SELECT *, row_number() OVER (ORDER BY number DESC) AS rn FROM numbered WHERE number IS NOT NULL) q WHERE rn > 5")
def kv_log_retention(spark, sf_dir):
    return names.removable_logs(_log_names(spark, sf_dir))


@query("SELECT CAST(sum(strlen(CAST(conv_id AS VARCHAR)) + 8 + coalesce(strlen(text), 0)) AS BIGINT) AS bytes, count(*) AS entries FROM conversations")
def kv_memtable_usage(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "conversations")
    return blocks.memory_usage(rows, F.col("conv_id").cast("string"), F.col("text"))


@query(
    """SELECT conv_id, turn, CAST(sum(strlen(CAST(conv_id AS VARCHAR)) + 8 + coalesce(strlen(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) // 1024 AS buffer
FROM conversations"""
)
def kv_memtable_switch(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "conversations")
    return blocks.buffers(rows, "conv_id", "turn", F.col("conv_id").cast("string"), F.col("text"), 1024).select("conv_id", "turn", "buffer")


# table files


@query(f"WITH {_OPS} SELECT min(key) AS smallest, max(key) AS largest, count(*) AS entries FROM ops")
def kv_flush_range(spark, sf_dir):
    return levels.key_range(tables.event_ops(spark, sf_dir))


_BLOCKS = f"""{_FILES}, placed AS (SELECT event_id // 500 + 1 AS file_number, event_id AS key, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS place FROM events),
blocked AS (SELECT file_number, key, place // 32 AS block, (place % 32) // 15 AS restart FROM placed)"""


def _blocked(spark, sf_dir) -> DataFrame:
    rows = tables.read(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 500) + 1).cast("long").alias("file_number"), F.col("event_id").alias("key"))
    return blocks.blocks(rows, 32)


@query(f"WITH {_BLOCKS} SELECT file_number, block, max(key) AS last_key, count(*) AS entries FROM blocked GROUP BY 1, 2")
def kv_blocks(spark, sf_dir):
    return blocks.block_index(_blocked(spark, sf_dir))


@query(f"WITH {_BLOCKS} SELECT file_number, block, restart, min(key) AS first_key, count(*) AS entries FROM blocked GROUP BY 1, 2, 3")
def kv_restarts(spark, sf_dir):
    return _blocked(spark, sf_dir).groupBy("file_number", "block", "restart").agg(F.min("key").alias("first_key"), F.count("*").alias("entries"))


@query(f"WITH {_BLOCKS}, ix AS (SELECT file_number, block, max(key) AS last_key FROM blocked GROUP BY 1, 2) SELECT file_number, min(block) AS block FROM ix WHERE last_key >= 777 GROUP BY 1")
def kv_find_block(spark, sf_dir):
    return blocks.find_block(blocks.block_index(_blocked(spark, sf_dir)), 777)


# garbage collection and compaction

_GC = f"""{_OPS}, striped AS (SELECT *, CASE WHEN seq <= 100 THEN 100 WHEN seq <= 2500 THEN 2500 ELSE 4611686018427387904 END AS stripe FROM ops),
kept AS (SELECT key, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key, stripe ORDER BY seq DESC) AS rn FROM striped) q WHERE rn = 1)"""


@query(f"WITH {_GC} SELECT key, seq, kind, value FROM kept")
def kv_gc(spark, sf_dir):
    return versions.collect_garbage(tables.event_ops(spark, sf_dir), [100, 2500])


@query(f"WITH {_GC} SELECT key, seq, kind, value FROM (SELECT *, min(CASE WHEN kind = 1 THEN seq END) OVER (PARTITION BY key) AS first_put FROM kept) q WHERE seq >= first_put")
def kv_gc_bottom(spark, sf_dir):
    return versions.collect_garbage(tables.event_ops(spark, sf_dir), [100, 2500], bottom=True)


@query(f"WITH {_GC.replace('FROM events)', 'FROM events WHERE (event_id // 500) % 7 = 0)', 1)} SELECT key, seq, kind, value FROM kept")
def kv_compact_level0(spark, sf_dir):
    ops = tables.event_ops(spark, sf_dir).where(F.floor((F.col("seq") - 1) / 500) % 7 == 0)
    return versions.collect_garbage(ops, [100, 2500])


_RANGES = [(1, 10, 20), (2, None, 15), (3, 140, None), (4, None, None), (5, -5, -1)]


@query(
    f"""WITH {_FILES}, ranges AS (SELECT CAST(a AS INT) AS range_id, CAST(b AS BIGINT) AS st, CAST(c AS BIGINT) AS en FROM (VALUES (1, 10, 20), (2, NULL, 15), (3, 140, NULL), (4, NULL, NULL), (5, -5, -1)) v(a, b, c))
SELECT range_id, file_number FROM ranges JOIN files ON (smallest IS NULL OR en IS NULL OR smallest <= en) AND (largest IS NULL OR st IS NULL OR largest >= st)"""
)
def kv_files_overlap(spark, sf_dir):
    ranges = spark.createDataFrame(_RANGES, "range_id int, start_key long, end_key long")
    return levels.files_for_ranges(tables.event_files(spark, sf_dir), ranges)


_LEVELS = f"""{_FILES}, lv AS (SELECT CAST(range AS INT) AS level FROM range(7)),
sums AS (SELECT CAST(level AS INT) AS level, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY 1),
st AS (SELECT lv.level, coalesce(file_count, 0) AS file_count, coalesce(total_size, 0) AS total_size,
       CAST(CASE WHEN lv.level = 0 THEN 4 * 10000.0e0 ELSE 10000.0e0 * pow(10, lv.level) END AS BIGINT) AS target_size FROM lv LEFT JOIN sums USING (level)),
stats AS (SELECT *, CASE WHEN level = 0 THEN file_count >= 4 ELSE total_size > target_size END AS needs_compaction FROM st)"""


@query(f"WITH {_LEVELS} SELECT level, file_count, total_size, target_size, needs_compaction FROM stats")
def kv_levels(spark, sf_dir):
    return levels.level_stats(tables.event_files(spark, sf_dir), write_buffer=10_000)


@query(f"WITH {_LEVELS} SELECT max(needs_compaction) AS needed FROM stats")
def kv_needs_compaction(spark, sf_dir):
    return levels.needs_compaction(tables.event_files(spark, sf_dir), write_buffer=10_000)


@query("SELECT CAST(range AS INT) AS level, CAST(CASE WHEN range = 0 THEN 4 * 4194304.0e0 ELSE 4194304.0e0 * pow(10, range) END AS BIGINT) AS target_size FROM range(7)")
def kv_target_size(spark, sf_dir):
    return levels.all_levels(spark).withColumn("target_size", sizing.level_target(F.col("level")))


@query(f"WITH {_FILES} SELECT file_number FROM (SELECT *, sum(size) OVER (ORDER BY file_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM files WHERE level = 1) q WHERE c <= 201000 // 2")
def kv_select_files(spark, sf_dir):
    return levels.select_files(tables.event_files(spark, sf_dir), 1, 201_000)


@query(
    f"""WITH {_FILES}, p AS (SELECT level, round(least(1.0e0, 0.4e0 * count(*) / (4 * CAST(pow(10, level) AS BIGINT)) + 0.4e0 * sum(size) / 1000000 + 0.2e0 * least(1.0e0, 6 / 24.0e0)), 6) AS priority FROM files GROUP BY level)
SELECT level, priority, CASE WHEN priority > 0.7 THEN 'aggressive' WHEN priority > 0.3 THEN 'standard' ELSE 'lazy' END AS mode FROM p"""
)
def kv_priority(spark, sf_dir):
    return levels.priorities(tables.event_files(spark, sf_dir), 1_000_000, 6.0)


@query(f"WITH {_FILES} SELECT level, file_number, size FROM files WHERE file_number NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def kv_remove_files(spark, sf_dir):
    gone = tables.read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("file_number"))
    return levels.remove_files(tables.event_files(spark, sf_dir), gone).select("level", "file_number", "size")


@query("SELECT CAST(coalesce(min(seq), 0) AS BIGINT) AS oldest FROM (SELECT o_orderkey AS seq, o_custkey % 3 AS ref_count FROM orders) s WHERE ref_count > 0")
def kv_oldest_snapshot(spark, sf_dir):
    held = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 3).alias("ref_count"))
    return levels.oldest_snapshot(held)


# Bloom filters

_SIZES = "sizes AS (SELECT file_number, size // 100 AS n, p FROM files, (VALUES (0.01e0), (0.001e0), (0.2e0)) v(p))"


def _sizes(spark, sf_dir) -> DataFrame:
    n = F.expr("size div 100")
    return tables.event_files(spark, sf_dir).select("file_number", n.alias("n"), F.explode(F.array(F.lit(0.01), F.lit(0.001), F.lit(0.2))).alias("p"))


@query(
    f"""WITH {_FILES}, {_SIZES}, b AS (SELECT *, CAST(ceil(-n * ln(p) / pow(ln(2), 2)) AS BIGINT) AS m FROM sizes)
SELECT file_number, n, p, m, CAST(ceil(m / n * ln(2)) AS INT) AS k FROM b"""
)
def kv_bloom_params(spark, sf_dir):
    sized = _sizes(spark, sf_dir).withColumn("m", sizing.bloom_bits(F.col("n"), F.col("p")))
    return sized.withColumn("k", sizing.bloom_hashes(F.col("n"), F.col("m")))


@query(
    f"""WITH {_FILES}, {_SIZES}, b AS (SELECT *, CAST(ceil(-n * ln(p) / pow(ln(2), 2)) AS BIGINT) AS m FROM sizes), c AS (SELECT *, CAST(ceil(m / n * ln(2)) AS INT) AS k FROM b)
SELECT file_number, p, round(pow(1 - exp(-k * n / m), k), 9) AS fp_rate, CAST(floor(m / (-ln(0.01) / pow(ln(2), 2))) AS BIGINT) AS capacity, CAST(ceil(m / 8) + 20 AS BIGINT) AS memory FROM c"""
)
def kv_bloom_fpr(spark, sf_dir):
    sized = kv_bloom_params(spark, sf_dir)
    m = F.col("m")
    return sized.select("file_number", "p", F.round(sizing.bloom_error(F.col("n"), m, F.col("k")), 9).alias("fp_rate"), sizing.bloom_capacity(m).alias("capacity"), sizing.bloom_memory(m).alias("memory"))


def _file_keys(spark, sf_dir) -> DataFrame:
    run = (F.floor(F.col("event_id") / 500) + 1).cast("long")
    return tables.read(spark, sf_dir, "events").select(run.alias("file_number"), F.col("user_id").alias("key")).distinct()


@query("SELECT event_id // 500 + 1 AS file_number, count(DISTINCT user_id) AS probes, CAST(0 AS BIGINT) AS false_negatives FROM events GROUP BY 1")
def kv_bloom_probe(spark, sf_dir):
    """Every stored key is found: no filter has a false negative."""
    stored = stage(_file_keys(spark, sf_dir), "file-keys")
    return bloom.may_contain(stage(bloom.build(stored), "filters"), stored).groupBy("file_number").agg(F.count("*").alias("probes"), F.count_if(~F.col("maybe")).alias("false_negatives"))


@query("SELECT count(DISTINCT user_id) AS probes, CAST(0 AS BIGINT) AS false_negatives FROM events")
def kv_bloom_merge(spark, sf_dir):
    """Filters of one size merged: what was in either is found."""
    stored = stage(_file_keys(spark, sf_dir), "file-keys")
    shapes = stored.groupBy("file_number").agg(F.count("*").alias("key_count"), F.lit(1 << 16).cast("long").alias("m"), F.lit(5).alias("k"))
    probes = stored.select(F.lit(0).alias("file_number"), "key").distinct()
    return bloom.may_contain(stage(bloom.merge(stage(bloom.build_sized(stored, shapes), "filters"), 0), "merged"), probes).agg(F.count("*").alias("probes"), F.count_if(~F.col("maybe")).alias("false_negatives"))


def _md5(number: int) -> str:
    return f"CAST('0x' || substr(md5('{number}:' || CAST(key AS VARCHAR)), 1, 15) AS BIGINT)"


_LN2 = "pow(ln(2), 2)"
_FILTERS = f"""stored AS (SELECT DISTINCT event_id // 500 + 1 AS file_number, user_id AS key FROM events),
counted AS (SELECT file_number, count(*) AS key_count FROM stored GROUP BY 1),
with_m AS (SELECT *, CAST(ceil(-key_count * ln(0.01e0) / {_LN2}) AS BIGINT) AS m FROM counted),
sized AS (SELECT *, CAST(ceil(m / key_count * ln(2)) AS INT) AS k, CAST(ceil(m / {bloom.BUCKET_BITS}) AS BIGINT) AS buckets FROM with_m),
cut AS (SELECT *, CAST(ceil(m / buckets) AS BIGINT) AS size FROM sized)"""
_PLACES = f"{_md5(2)} % buckets AS bucket, unnest(list_transform(range(k), lambda i: ({_md5(0)} % size + i * ({_md5(1)} % greatest(size - 1, 1) + 1)) % size)) AS place"


@query(
    f"""WITH {_FILES}, {_FILTERS},
bits AS (SELECT DISTINCT file_number, bucket, place FROM (SELECT file_number, {_PLACES} FROM stored JOIN cut USING (file_number)) q),
near AS (SELECT DISTINCT file_number, s_suppkey AS key FROM supplier JOIN files ON s_suppkey BETWEEN smallest AND largest),
asked AS (SELECT DISTINCT * FROM (SELECT file_number, key, {_PLACES} FROM near JOIN cut USING (file_number)) q),
answered AS (SELECT a.file_number, a.key, bool_and(b.place IS NOT NULL) AS maybe FROM asked a LEFT JOIN bits b USING (file_number, bucket, place) GROUP BY 1, 2),
f AS (SELECT a.*, s.key IS NOT NULL AS held FROM answered a LEFT JOIN stored s USING (file_number, key))
SELECT file_number, count(*) AS probes, count(*) FILTER (maybe) AS hits, count(*) FILTER (maybe AND NOT held) AS found_nothing,
       CASE WHEN count(*) FILTER (NOT held) > 0 THEN count(*) FILTER (maybe AND NOT held) / count(*) FILTER (NOT held) ELSE 0.0e0 END AS actual_fp_rate FROM f GROUP BY 1"""
)
def kv_bloom_prune(spark, sf_dir):
    """Per file: probes of all suppliers' numbers in its range, "maybe" answers, those that
    found nothing, and their share of the absent ones. Hashes are those that SQL has too."""
    stored = stage(_file_keys(spark, sf_dir), "file-keys")
    filters = stage(bloom.build(stored, portable=True), "filters")
    probes = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")).distinct()
    files = stage(tables.event_files(spark, sf_dir), "files")
    asked = bloom.may_contain_near(filters, probes, files, portable=True).join(stored.withColumn("stored", F.lit(True)), ["file_number", "key"], "left")
    wrong = F.count_if(F.col("maybe") & F.col("stored").isNull())
    absent = F.count_if(F.col("stored").isNull())
    return asked.groupBy("file_number").agg(F.count("*").alias("probes"), F.count_if("maybe").alias("hits"), wrong.alias("found_nothing"), F.when(absent > 0, wrong / absent).otherwise(0.0).alias("actual_fp_rate"))


@query(
    f"""WITH {_FILTERS}, e AS (SELECT *, pow(1 - exp(-k * key_count / m), k) AS error, CAST(ceil(m / 8) + 20 AS BIGINT) AS bytes FROM cut)
SELECT count(*) AS total_filters, CAST(sum(bytes) AS BIGINT) AS total_memory_bytes, round(avg(error), 9) AS average_fp_rate, CAST(sum(bytes) AS BIGINT) // count(*) AS memory_per_filter FROM e"""
)
def kv_bloom_stats(spark, sf_dir):
    return bloom.stats(bloom.build(_file_keys(spark, sf_dir)))


_RESIZE = f"""{_FILTERS}, held AS (SELECT file_number, key_count, CAST(CASE WHEN file_number % 2 = 0 THEN m ELSE 1024 END AS BIGINT) AS m, CASE WHEN file_number % 3 = 0 THEN 2 ELSE k END AS k, m AS new_m, k AS new_k FROM cut)"""


def _odd_filters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Filters of which some have other sizes than their keys ask for, and the keys."""
    stored = stage(_file_keys(spark, sf_dir), "file-keys")
    sized = bloom.parameters(stored).withColumn("m", F.when(F.col("file_number") % 2 == 0, F.col("m")).otherwise(1024).cast("long")).withColumn("k", F.when(F.col("file_number") % 3 == 0, 2).otherwise(F.col("k")))
    return bloom.build_sized(stored, sized), stored


@query(f"WITH {_RESIZE} SELECT file_number, m, k, key_count, new_m, new_k, abs(new_m - m) > 0.2e0 * m OR abs(new_k - k) > 2 AS resize FROM held")
def kv_bloom_resize(spark, sf_dir):
    return bloom.needs_resize(_odd_filters(spark, sf_dir)[0], 0.01)


@query(
    f"""WITH {_RESIZE}, s AS (SELECT *, abs(new_m - m) > 0.2e0 * m OR abs(new_k - k) > 2 AS resize FROM held)
SELECT file_number, CASE WHEN resize THEN new_m ELSE m END AS m, CASE WHEN resize THEN new_k ELSE k END AS k, key_count, CAST(0 AS BIGINT) AS false_negatives FROM s"""
)
def kv_bloom_optimize(spark, sf_dir):
    """Filters far from the size for their keys are built anew, and still find every key."""
    filters, stored = _odd_filters(spark, sf_dir)
    better = stage(bloom.optimize(filters, stored), "filters")
    lost = bloom.may_contain(better, stored).groupBy("file_number").agg(F.count_if(~F.col("maybe")).alias("false_negatives"))
    return better.select(*bloom.SHAPE).distinct().join(lost, "file_number")


# keys and records


@query("SELECT p_partkey, list_min(list_concat(list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: substr(p_name, i, 1) <> substr(p_type, i, 1)), [least(length(p_name), length(p_type)) + 1])) - 1 AS shared FROM part")
def kv_common_prefix(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").select("p_partkey", keys.common_prefix("p_name", "p_type").alias("shared"))


@query(f"WITH {_OPS} SELECT key, seq, kind, printf('%016x', seq * 256 + kind) AS suffix FROM ops")
def kv_internal_key(spark, sf_dir):
    return tables.event_ops(spark, sf_dir).select("key", "seq", "kind", keys.packed_suffix("seq", "kind").alias("suffix"))


@query(f"WITH {_OPS} SELECT key, seq, kind FROM ops")
def kv_internal_key_round_trip(spark, sf_dir):
    key = F.col("key").cast("string").cast("binary")
    decoded = tables.event_ops(spark, sf_dir).select(keys.decode_internal_key(keys.encode_internal_key(key, F.col("seq"), F.col("kind"))).alias("d"))
    return decoded.select(F.col("d.key").cast("string").cast("long").alias("key"), F.col("d.seq").alias("seq"), F.col("d.kind").alias("kind"))


@query("SELECT c_custkey, CAST(CASE WHEN c_name < c_mktsegment THEN -1 WHEN c_name > c_mktsegment THEN 1 ELSE 0 END AS INT) AS compared, c_name IS NOT DISTINCT FROM c_mktsegment AS equal FROM customer")
def kv_compare(spark, sf_dir):
    a, b = F.col("c_name").cast("binary"), F.col("c_mktsegment").cast("binary")
    return tables.read(spark, sf_dir, "customer").select("c_custkey", keys.compare(a, b).alias("compared"), keys.equal(a, b).alias("equal"))


_HEX = "array_to_string(list_transform({}, lambda b: printf('%02x', b)), '')"
_BYTES = "list_transform(string_split({}, ''), lambda c: ascii(c))"


def _little(value: str, size: int) -> str:
    return f"list_transform(range({size}), lambda i: ({value} >> CAST(8 * i AS INT)) & 255)"


_RECORDS = f"""{_OPS}, t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
parts AS (SELECT seq, kind, {_BYTES.format("CAST(key AS VARCHAR)")} AS k, CASE WHEN kind = 1 AND value IS NOT NULL THEN {_BYTES.format("CAST(value AS VARCHAR)")} ELSE [] END AS v FROM ops),
body AS (SELECT seq, {_little("seq", 8)} || [CAST(kind AS BIGINT)] || {_little("len(k)", 4)} || k || {_little("len(v)", 4)} || v AS b FROM parts),
summed AS (SELECT seq, b, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM body, t),
records AS (SELECT seq, {_HEX.format("b || " + _little("crc", 4))} AS record FROM summed)"""


@query(f"WITH {_RECORDS} SELECT seq, record FROM records")
def kv_log_entry(spark, sf_dir):
    """Each operation's log record in hex; the SQL sums by a table of 256 values."""
    return tables.text_ops(spark, sf_dir).select("seq", F.lower(F.hex(keys.encode_log_record("seq", "kind", "key", "value"))).alias("record"))


@query(f"WITH {_OPS} SELECT key, seq, kind, CASE WHEN kind = 1 THEN coalesce(CAST(value AS VARCHAR), '') END AS value FROM ops")
def kv_recover_log(spark, sf_dir):
    """Operations written as log files, headers, lengths, checksums and all, and decoded again."""
    written = log_files.write_logs(tables.text_ops(spark, sf_dir), fresh_path(spark, "logs"))
    back = log_files.read_named(written)
    return back.select(F.col("key").cast("string").cast("long").alias("key"), "seq", "kind", F.col("value").cast("string").alias("value"))


# the store itself: loaded by thirds, deleted from, flushed and compacted, then read


def _stored(spark, sf_dir, snapshots: tuple[int, ...] = ()) -> tuple[Store, list[int]]:
    """events in a store, after SNAPSHOT events and again after 5000 a flush (and a snapshot
    where asked for) and a compaction of half the keys of level 0, then of a part of level 1."""
    ops = tables.text_ops(spark, sf_dir)
    store, held = Store.open(spark, fresh_path(spark, "store"), Options(write_buffer=1 << 40, file_bytes=64 << 10)), []
    for low, high in ((0, 2500), (2500, 5000), (5000, 1 << 60)):
        part = ops.where((F.col("seq") > low) & (F.col("seq") <= high))
        store.load(part.select(F.col("seq").alias("op_index"), "key", "kind", "value"))
        if high in snapshots:
            held.append(store.snapshot())
        store.flush()
        store.compact_range(0, b"1", b"5")
        store.compact_range(1, b"3", b"4")
    return store, held


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").cast("long").alias("key"), F.col("value").cast("string").cast("double").alias("value"), "seq")


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest")
def kv_store_view(spark, sf_dir):
    store, _ = _stored(spark, sf_dir)
    return _typed(store.view())


@query(f"WITH {_latest(SNAPSHOT)} SELECT key, value, seq FROM latest")
def kv_store_snapshot(spark, sf_dir):
    """What a snapshot saw, read after later writes, a garbage collection and full compaction."""
    store, (seen,) = _stored(spark, sf_dir, (SNAPSHOT,))
    store.force_compact()
    return _typed(store.view(seen))


@query(f"WITH {_latest()} SELECT key, value, seq FROM latest WHERE key BETWEEN 100 AND 199")
def kv_store_range(spark, sf_dir):
    """Keys in order of their bytes: all of three digits that begin with 1."""
    store, _ = _stored(spark, sf_dir)
    return _typed(store.range(b"100", b"199").where(F.length("key") == 3))


@query(f"WITH {_latest()} SELECT CAST(count(*) AS BIGINT) AS versions, CAST(count(DISTINCT key) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS deletions, max(seq) AS last_seq FROM latest")
def kv_store_compacted(spark, sf_dir):
    """After all is compacted to the last level, without snapshots: a version a visible key, no deletion."""
    store, _ = _stored(spark, sf_dir)
    for _ in range(store.options.max_levels):
        store.force_compact()
    return store.ops().agg(F.count("*").alias("versions"), F.count_distinct("key").alias("keys"), F.count_if(F.col("kind") == 0).alias("deletions"), F.max("seq").alias("last_seq"))


@query(
    """WITH batches AS (SELECT c_custkey AS key, c_custkey % 50 AS turn, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS kind, c_name AS value FROM customer),
again AS (SELECT *, row_number() OVER (ORDER BY turn, key) AS place FROM batches),
w AS (SELECT key % 40 AS key, kind, value, row_number() OVER (PARTITION BY key % 40 ORDER BY place DESC) AS rn FROM again)
SELECT key, value FROM w WHERE rn = 1 AND kind = 1"""
)
def kv_store_load(spark, sf_dir):
    """A bulk load that writes each of 40 keys many times, put and deleted in an order that is not the table's."""
    store = Store.open(spark, fresh_path(spark, "store"))
    rows = tables.read(spark, sf_dir, "customer").select(F.struct(F.col("c_custkey") % 50, "c_custkey").alias("op_index"), (F.col("c_custkey") % 40).cast("string").cast("binary").alias("key"), F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(1).alias("kind"), F.col("c_name").cast("binary").alias("value"))
    store.load(rows)
    return store.view().select(F.col("key").cast("string").cast("long").alias("key"), F.col("value").cast("string").alias("value"))


@query(
    f"""WITH {_ORDERS}, written AS (SELECT key % 10 AS key, seq % 100 AS seq, kind, value, seq AS written FROM ops)
SELECT key, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key, seq, kind ORDER BY written DESC) AS rn FROM written) q WHERE rn = 1"""
)
def kv_overwrite(spark, sf_dir):
    """Writes of an equal internal key replace each other."""
    ops = tables.order_ops(spark, sf_dir).select((F.col("key") % 10).alias("key"), (F.col("seq") % 100).alias("seq"), "kind", "value", F.col("seq").alias("written"))
    return versions.last_written(ops, "written")
