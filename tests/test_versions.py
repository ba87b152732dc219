"""Reads, scans, garbage collection and level planning on small logs."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import levels, ranges, scan, versions

OPS = "key binary, seq long, kind int, value binary"


def ops(spark, *rows):
    return spark.createDataFrame([(k, s, d, v) for k, s, d, v in rows], OPS)


def visible(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_overwrite_delete_and_put_again(spark):
    log = ops(spark, (b"a", 1, 1, b"v1"), (b"a", 3, 0, None), (b"a", 5, 1, b"v5"), (b"e", 2, 1, b""), (b"z", 4, 0, None))
    want = {0: {}, 1: {b"a": b"v1"}, 2: {b"a": b"v1", b"e": b""}, 3: {b"e": b""}, 4: {b"e": b""}, 5: {b"a": b"v5", b"e": b""}}
    for s, held in want.items():
        assert visible(versions.latest(log, s)) == held
    assert versions.get(log, F.lit(b"a"), 3).count() == 0
    assert [r.seq for r in versions.versions(log, F.lit(b"a"), 4).collect()] == [1, 3]
    assert {bytes(r.key) for r in versions.deleted_keys(log).collect()} == {b"z"}


def test_keys_with_zero_bytes_stay_apart(spark):
    log = ops(spark, (b"a", 1, 1, b"1"), (b"a\0", 2, 1, b"2"), (b"a", 3, 0, None))
    assert visible(versions.latest(log)) == {b"a\0": b"2"}


def test_newest_null_value_is_not_skipped(spark):
    log = spark.createDataFrame([(1, 1, 1, 5.0), (1, 2, 1, None)], "key long, seq long, kind int, value double")
    assert [tuple(r) for r in versions.latest(log).collect()] == [(1, None, 2)]


def test_multi_get_keeps_absent_and_repeated_keys(spark):
    log = ops(spark, (b"a", 1, 1, b"1"))
    wanted = spark.createDataFrame([(b"a",), (b"a",), (b"q",)], "key binary")
    assert sorted((bytes(r.key), r.seq) for r in versions.multi_get(log, wanted).where("seq is not null").collect()) == [(b"a", 1), (b"a", 1)]
    assert versions.multi_get(log, wanted).count() == 3


def test_multi_snapshot_without_snapshots_is_empty(spark):
    log = ops(spark, (b"a", 1, 1, b"1"))
    assert versions.multi_snapshot(log, []).count() == 0
    assert versions.multi_snapshot(log, [0, 1]).select("snapshot").collect()[0][0] == 1


op = st.tuples(st.sampled_from([b"a", b"a\0", b"ab", b"b", b"\xff"]), st.integers(0, 1), st.binary(max_size=2))


def model(rows, s):
    held = {}
    for i, (k, kind, v) in enumerate(rows, 1):
        if i <= s:
            held.pop(k, None)
            if kind:
                held[k] = v
    return held


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(op, max_size=20), live=st.sets(st.integers(0, 20), max_size=3))
def test_reads_and_garbage_collection_follow_the_model(spark, rows, live):
    log = ops(spark, *((k, i, kind, v if kind else None) for i, (k, kind, v) in enumerate(rows, 1)))
    marks = sorted(live | {len(rows)})
    for kept in (log, versions.collect_garbage(log, list(live)), versions.collect_garbage(log, list(live), bottom=True)):
        got = {}
        for r in versions.multi_snapshot(kept, marks).collect():
            got.setdefault(r.snapshot, {})[bytes(r.key)] = bytes(r.value)
        for s in marks:
            assert got.get(s, {}) == model(rows, s)


def test_dropping_every_tombstone_would_be_noticed(spark):
    log = ops(spark, (b"a", 1, 1, b"1"), (b"a", 2, 0, None))
    wrong = versions.collect_garbage(log, [1]).where("kind = 1")
    assert visible(versions.latest(wrong)) != visible(versions.latest(log))


def test_tombstone_goes_only_at_the_bottom(spark):
    upper = ops(spark, (b"a", 2, 0, None))
    assert versions.collect_garbage(upper, []).count() == 1
    assert versions.collect_garbage(upper, [], bottom=True).count() == 0


def test_scans(spark):
    view = spark.createDataFrame([(k,) for k in (1, 3, 5, 7)], "key long")
    keys = lambda df: [r.key for r in df.collect()]
    assert keys(scan.seek(view, 3)) == [3] and keys(scan.seek(view, 4)) == [5] and keys(scan.seek(view, 8)) == []
    assert keys(scan.first(view)) == [1] and keys(scan.last(view)) == [7]
    assert keys(scan.following(view, 3)) == [5] and keys(scan.preceding(view, 3)) == [1] and keys(scan.preceding(view, 1)) == []
    assert keys(scan.range_scan(view, 3, 5)) == [3, 5] and keys(scan.range_scan(view, None, 1)) == [1] and len(keys(scan.range_scan(view))) == 4
    near = {r.key: (r.prev_key, r.next_key) for r in scan.neighbours(view).collect()}
    assert near == {1: (None, 3), 3: (1, 5), 5: (3, 7), 7: (5, None)}
    empty = view.limit(0)
    assert keys(scan.first(empty)) == keys(scan.last(empty)) == keys(scan.neighbours(empty)) == []


def test_merge_keeps_equal_rows_in_order_of_sources(spark):
    a = ops(spark, (b"k", 1, 1, b"x"), (b"m", 2, 1, b"x"))
    b = ops(spark, (b"k", 1, 1, b"y"))
    c = ops(spark, (b"a", 9, 1, b"z"))
    assert [(bytes(r.key), r.source) for r in scan.merge([a, b, c]).collect()] == [(b"a", 2), (b"k", 0), (b"k", 1), (b"m", 0)]
    assert [bytes(r.key) for r in scan.merge_seek([a, b, c], F.lit(b"b"), 2).collect()] == [b"k", b"k"]
    assert [bytes(r.key) for r in scan.merge_before([a, b, c], F.lit(b"m")).collect()] == [b"k"]


def test_sequences_are_dense(spark):
    batch = spark.range(1000).select((F.col("id") * 7 % 1000).alias("op_index"))
    got = sorted((r.op_index, r.seq) for r in versions.with_sequence(batch, 5).collect())
    assert got == [(i, i + 5) for i in range(1000)]
    assert sorted(r.seq for r in versions.consecutive(batch.limit(3), 10).collect()) == [10, 11, 12]


def test_overlap_table(spark):
    bounds = [None, *(bytes([c]) for c in b"abd")]
    cases = list(itertools.product(bounds, repeat=4))
    df = spark.createDataFrame(cases, "smallest binary, largest binary, start binary, end binary")
    got = [r[0] for r in df.select(levels.overlaps(*map(F.col, df.columns))).collect()]

    def want(lo, hi, start, end):
        return not (lo is not None and end is not None and lo > end or hi is not None and start is not None and hi < start)

    assert got == [want(*c) for c in cases]


@pytest.mark.parametrize("start, end, hit", [("a", "b", True), ("d", "e", True), ("e", "f", False), (None, "a", False), ("d", None, True), (None, None, True)])
def test_closed_ranges(spark, start, end, hit):
    files = spark.createDataFrame([(1, 1, 10, b"b", b"d"), (1, 2, 10, None, None)], "level int, file_number long, size long, smallest binary, largest binary")
    as_bytes = lambda x: None if x is None else x.encode()
    found = {r.file_number for r in levels.files_in_range(files, 1, as_bytes(start), as_bytes(end)).collect()}
    assert found == ({1, 2} if hit else {2})


def test_selection_takes_the_prefix_within_half(spark):
    files = spark.createDataFrame([(lv, i, s) for lv, i, s in ((0, 1, 9), (0, 2, 9), (1, 3, 4), (1, 4, 4), (1, 5, 1))], "level int, file_number long, size long")
    pick = lambda level, target: [r[0] for r in levels.select_files(files, level, target).orderBy("file_number").collect()]
    assert pick(0, 1) == [1, 2] and pick(1, 9) == [3] and pick(1, 16) == [3, 4] and pick(1, 2) == []


def test_neighbours_of_binary_keys_over_many_ranges(spark):
    keys = sorted({str(i * 7919 % 5000).encode() for i in range(900)})
    view = spark.createDataFrame([(k,) for k in keys], "key binary")
    got = sorted((bytes(r.key), r.prev_key and bytes(r.prev_key), r.next_key and bytes(r.next_key)) for r in scan.neighbours(view).collect())
    assert got == list(zip(keys, [None, *keys[:-1]], [*keys[1:], None], strict=True))


def test_sequences_over_uneven_and_empty_batches(spark):
    batch = spark.range(3000).select((F.col("id") * F.col("id")).alias("op_index"))
    assert [r.seq for r in versions.with_sequence(batch, 1).orderBy("op_index").collect()] == list(range(1, 3001))
    assert versions.with_sequence(batch.limit(0), 1).count() == 0


def test_numbers_and_neighbours_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("op_index"), F.lit(1).alias("_x"))
    got = {r.op_index: r.seq for r in versions.with_sequence(rows.repartition(7), 10).collect()}
    assert got == {i: 10 + i for i in range(5000)}
    view = rows.select((F.col("op_index") * 2).alias("key"))
    assert sorted(tuple(r) for r in scan.neighbours(view).collect())[:2] == [(0, None, 2), (2, 0, 4)] and scan.neighbours(view).where("prev_key is null or next_key is null").count() == 2


def test_the_last_write_of_an_equal_internal_key_holds(spark):
    log = spark.createDataFrame([(b"a", 1, 1, b"x", 1), (b"a", 1, 1, b"z", 3), (b"a", 1, 1, b"y", 2), (b"a", 1, 0, None, 4)], OPS + ", written long")
    got = {(bytes(r.key), r.seq, r.kind): r.value for r in versions.last_written(log, "written").collect()}
    assert got == {(b"a", 1, 1): b"z", (b"a", 1, 0): None}


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_range_joins_small_and_large(spark, monkeypatch, limit):
    monkeypatch.setattr(levels.broadcast_if_small, "__defaults__", (limit,))
    files = [(i, (i * 37) % 200 if i % 9 else None, (i * 37) % 200 + i % 30 if i % 11 else None) for i in range(80)]
    ranges = [(i, (i * 53) % 220 - 10 if i % 5 else None, (i * 53) % 220 if i % 7 else None) for i in range(40)]
    f, r = spark.createDataFrame(files, "file_number int, smallest long, largest long"), spark.createDataFrame(ranges, "range_id int, start_key long, end_key long")
    low, high = (lambda x: -1e9 if x is None else x), (lambda x: 1e9 if x is None else x)
    want = {(q, n) for q, s, e in ranges for n, a, b in files if low(a) <= high(e) and high(b) >= low(s)}
    got = [tuple(x) for x in levels.files_for_ranges(f, r).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    keys = spark.createDataFrame([(k,) for k in [*range(-5, 260, 3), None]], "key long")
    near = [tuple(x) for x in levels.near_ranges(keys, f).collect()]
    assert len(near) == len(set(near)) and set(near) == {(n, k) for (k,) in keys.collect() if k is not None for n, a, b in files if low(a) <= k <= high(b)}


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_range_joins_are_dealt_over_tasks(spark, monkeypatch, limit):
    """Few keys can be many pairs: no task makes most of them, whether or not files lie where most keys do."""
    monkeypatch.setattr(levels.broadcast_if_small, "__defaults__", (limit,))
    files = spark.range(50).select(F.col("id").alias("file_number"), F.lit(100).cast("long").alias("smallest"), F.lit(299).cast("long").alias("largest"))
    keys = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("key")).distinct()
    monkeypatch.setattr(ranges, "SLICES", 20)
    near = levels.near_ranges(keys, files).cache()
    assert near.count() == near.distinct().count() == 50 * 200 and near.where("key not between 100 and 299").count() == 0
    most = near.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 0.6 * near.count()
    near.unpersist()
