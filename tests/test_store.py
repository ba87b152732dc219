"""The store: writes, snapshots, flushes, compaction, reopening, against a dict of versions."""

import random
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from tidemark.plans.manifest import File, Folder
from tidemark.plans.options import BatchCommitted, Conflict, Corrupted, Options, ReadOnly, StoreClosed, StoreError
from tidemark.plans.store import Batch, Store


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/db"


def visible(store, snapshot=None):
    return {bytes(r.key): bytes(r.value) for r in store.view(snapshot).collect()}


def test_write_close_and_reopen(spark, root):
    with_values = {b"test": b"value", b"hello": b"world", b"key1": b"value1"}
    store = Store.open(spark, root)
    for k, v in with_values.items():
        store.put(k, v)
    store.close()
    again = Store.open(spark, root)
    assert {k: again.get(k) for k in with_values} == with_values
    assert again.get(b"absent") is None and again.manifest.next_seq == 4


def test_batches(spark, root):
    store, batch = Store.open(spark, root), Batch()
    batch.put(b"k", b"1")
    batch.delete(b"k")
    batch.put(b"k", None)
    assert batch.size() == 3 and store.write(batch) == 3
    assert store.get(b"k") == b""
    batch.put(b"late", b"x")  # ignored once committed
    assert batch.size() == 3
    with pytest.raises(BatchCommitted):
        store.write(batch)
    batch.clear()
    batch.put(b"n", b"2")
    assert store.write(batch) == 4
    assert store.put(b"k", b"3") == 5 and store.get(b"k") == b"3"
    with pytest.raises(StoreError, match="empty"):
        store.put(b"", b"x")


def test_snapshots_don_t_see_later_writes(spark, root):
    store = Store.open(spark, root)
    store.put(b"a", b"1")
    s = store.snapshot()
    assert store.snapshot() == s and store.oldest_snapshot() == s
    store.put(b"a", b"2")
    store.delete(b"b")
    assert store.get(b"a", s) == b"1" and store.get(b"a") == b"2"
    store.release(s)
    assert store.oldest_snapshot() == s
    store.release(s)
    assert store.oldest_snapshot() == 0


def test_follows_the_model_through_flush_compaction_and_reopen(spark, root):
    rng, keys = random.Random(3), [b"a", b"a\0", b"ab", b"b", b"c", b"\xff"]
    store, held, frozen = Store.open(spark, root, Options(l0_trigger=2)), {}, {}
    for step in range(5):
        batch = Batch()
        for _ in range(6):
            k = rng.choice(keys)
            if rng.random() < 0.3:
                batch.delete(k)
                held.pop(k, None)
            else:
                v = str(rng.random()).encode()
                batch.put(k, v)
                held[k] = v
        store.write(batch)
        if step in (0, 2):
            frozen[store.snapshot()] = dict(held)
        if step % 2:
            store.flush()
        if step == 3:
            store.maintain()
            store.compact_range(1, b"a", b"b")
        if step == 3:
            store = Store.open(spark, root, Options(l0_trigger=2))
    store.force_compact()
    assert visible(store) == held
    for s, want in frozen.items():
        assert visible(store, s) == want
    before = store.ops().count()
    for s in frozen:
        store.release(s)
    for level in range(store.options.max_levels):
        store.compact_range(level)
    assert store.ops().count() == len(held) < before and visible(store) == held


def test_a_deeper_value_stays_deleted(spark, root):
    store = Store.open(spark, root)
    store.put(b"k", b"old")
    store.flush()
    store.compact_range(0)
    store.delete(b"k")
    store.flush()
    assert store.get(b"k") is None
    assert [(f.level, f.smallest) for f in store.manifest.files] == [(1, b"k".hex()), (0, b"k".hex())]
    store.force_compact()  # each level goes down by one
    assert store.get(b"k") is None and sorted(f.level for f in store.manifest.files) == [1, 2]
    store.compact_range(1)
    assert store.get(b"k") is None and store.ops().count() == 0


def test_bulk_load_and_range(spark, root):
    store = Store.open(spark, root, Options(partitions=3))
    rows = spark.range(500).select(F.col("id").alias("op_index"), F.format_string("k%03d", F.col("id") % 100).alias("key"), F.lit(1).alias("kind"), F.col("id").cast("string").alias("value"))
    assert store.load(rows) == 500
    store.flush()
    got = [(bytes(r.key), bytes(r.value)) for r in store.range(b"k010", b"k012").collect()]
    assert got == [(b"k010", b"410"), (b"k011", b"411"), (b"k012", b"412")]
    wanted = spark.createDataFrame([(b"k001",), (b"no",)], "key binary")
    assert {bytes(r.key): r.seq for r in store.multi_get(wanted).collect()} == {b"k001": 402, b"no": None}
    stats = {r.level: r.file_count for r in store.stats().collect()}
    assert stats == {0: 1, **dict.fromkeys(range(1, 7), 0)}
    assert store.summary()["last_sequence"] == 500 and store.summary()["flushes"] == 1 and store.history().count() == 1


def test_a_full_buffer_is_flushed(spark, root):
    store = Store.open(spark, root, Options(write_buffer=64))
    store.put(b"k", b"v" * 100)
    assert not store.manifest.logs and len(store.manifest.files) == 1 and store.get(b"k") == b"v" * 100


def test_errors(spark, root, tmp_path):
    with pytest.raises(StoreError, match="doesn't exist"):
        Store.open(spark, root, Options(create_if_missing=False))
    store = Store.open(spark, root)
    store.put(b"a", b"1")
    with pytest.raises(StoreError, match="exists"):
        Store.open(spark, root, Options(error_if_exists=True))
    reader = Store.open(spark, root, Options(read_only=True))
    for call in (lambda: reader.put(b"a", b"2"), lambda: reader.delete(b"a"), lambda: reader.flush(), lambda: reader.compact_range(0), lambda: reader.force_compact(), lambda: reader.maintain()):
        with pytest.raises(ReadOnly):
            call()
    assert reader.get(b"a") == b"1"
    with pytest.raises(StoreError, match="no level"):
        store.compact_range(7)
    other = Store.open(spark, root)
    other.put(b"a", b"2")
    with pytest.raises(Conflict):
        store.put(b"a", b"3")
    assert Store.open(spark, root).get(b"a") == b"2"
    store.close()
    for call in (lambda: store.get(b"a"), lambda: store.put(b"a", b"1"), store.stats, store.snapshot):
        with pytest.raises(StoreClosed):
            call()
    Folder(spark, root).publish("manifest/99999999.json", "{}")
    with pytest.raises(Corrupted):
        Store.open(spark, root)


def test_files_are_sorted_and_have_bloom_filters(spark, root, tmp_path):
    import pyarrow.parquet as pq

    store = Store.open(spark, root)
    batch = Batch()
    for i in range(50):
        batch.put(f"k{i * 37 % 50:02d}".encode(), b"v")
    store.write(batch)
    new = store.flush()
    part = next((tmp_path / "db" / new.path).glob("*.parquet"))
    keys = pq.read_table(part).column("key").to_pylist()
    assert keys == sorted(keys) and (new.smallest, new.largest, new.entries) == (b"k00".hex(), b"k49".hex(), 50)


def test_a_deleted_key_stays_deleted_when_an_older_version_is_shallower(spark, root):
    store = Store.open(spark, root)
    store.put(b"b", b"v1")
    store.flush()
    store.put(b"a", b"v2")
    store.delete(b"b")
    store.flush()
    store.compact_range(0, b"a", b"a")
    assert store.get(b"b") is None
    store.compact_range(1, b"a", b"a")
    assert store.get(b"b") is None and visible(store) == {b"a": b"v2"}


def test_a_deletion_waits_for_an_older_file_that_is_left_out(spark, root):
    """Deep in the tree, with the older version in a file of a level above."""
    store = Store.open(spark, root)
    store.put(b"b", b"old")
    older = store.flush()
    store.delete(b"b")
    store.put(b"c", b"x")
    newer = store.flush()
    files = [f if f.file_number == older.file_number else File(**asdict(f) | {"level": 2}) for f in store.manifest.files]
    store._publish(files=files)
    store.compact_range(2, b"c", b"c")
    assert store.get(b"b") is None and store.ops().where("kind = 0").count() == 1 and newer.file_number != older.file_number


@pytest.mark.parametrize("seed", [1, 2])
def test_random_writes_flushes_and_range_compactions(spark, root, seed):
    rng, keys = random.Random(seed), [bytes([97 + i]) for i in range(6)]
    store, held, frozen = Store.open(spark, root, Options(file_bytes=700)), {}, {}
    for step in range(13):
        what = rng.random()
        if what < 0.45:
            batch = Batch()
            for k in rng.sample(keys, rng.randint(1, 3)):
                if rng.random() < 0.45:
                    batch.delete(k)
                    held.pop(k, None)
                else:
                    held[k] = f"{step}".encode()
                    batch.put(k, held[k])
            store.write(batch)
        elif what < 0.6:
            store.flush()
        elif what < 0.66 and not frozen:
            frozen[store.snapshot()] = dict(held)
        else:
            low, high = sorted(rng.sample(keys, 2))
            store.compact_range(rng.randint(0, 3), low, high)
        if step % 5 == 4:
            assert visible(store) == held
    assert visible(store) == held
    for s, want in frozen.items():
        assert visible(store, s) == want


def test_large_outputs_become_several_files(spark, root):
    store = Store.open(spark, root, Options(file_bytes=2000, partitions=2))
    rows = spark.range(400).select(F.col("id").alias("op_index"), F.format_string("k%03d", (F.col("id") * 7) % 400).alias("key"), F.lit(1).alias("kind"), F.lit("value").alias("value"))
    store.load(rows)
    store.flush()
    files = sorted(store.manifest.files, key=lambda f: f.smallest)
    assert len(files) > 2 and sum(f.entries for f in files) == 400 and len({f.file_number for f in files}) == len(files)
    assert all(a.largest < b.smallest for a, b in zip(files, files[1:], strict=False))
    store.compact_range(0, b"k000", b"k001")
    assert {f.level for f in store.manifest.files} == {0, 1} and len(visible(store)) == 400
    assert store.manifest.next_file > max(f.file_number for f in store.manifest.files)


def test_readers_outlive_compaction_until_the_vacuum(spark, root, tmp_path):
    store = Store.open(spark, root)
    store.put(b"a", b"1")
    store.flush()
    store.put(b"b", b"2")
    before = store.view()
    store.force_compact()
    assert {bytes(r.key) for r in before.collect()} == {b"a", b"b"}
    assert store.vacuum() == 0 and store.summary()["retired"] > 0
    assert store.vacuum(0.0) > 0 and store.manifest.retired == [] and visible(store) == {b"a": b"1", b"b": b"2"}


def test_counters(spark, root):
    store = Store.open(spark, root)
    store.put(b"a", b"1")
    store.flush()
    store.put(b"z", b"1")
    store.flush()
    store.get(b"a")
    store.view()
    got = store.summary()
    assert (got["reads"], got["writes"], got["files_opened"], got["files_skipped"]) == (2, 2, 1, 1)
    assert (got["bloom_filters"], got["bloom_keys"]) == (2, 2) and got["bloom_bytes"] == 2 * (2 + 20) and 0 < got["bloom_error"] < 0.02


def test_a_filter_is_as_large_as_its_keys_ask_for(spark, tmp_path):
    """Parquet's own choice is a MB a file, and a compaction took these MB for data, so that files multiplied."""
    sizes = {}
    for bloom in (True, False):
        store, batch = Store.open(spark, f"file://{tmp_path}/{bloom}", Options(bloom=bloom)), Batch()
        for i in range(50):
            batch.put(f"k{i:02d}".encode(), b"v")
        store.write(batch)
        sizes[bloom] = store.flush().size
    assert 50 <= sizes[True] - sizes[False] < 1000


def test_compactions_don_t_multiply_files(spark, root):
    """Footers and filters are no data: files of a few entries are merged, not dealt out again."""
    store = Store.open(spark, root, Options(file_bytes=1000))
    rows = spark.range(200).select(F.col("id").alias("op_index"), F.format_string("k%03d", "id").alias("key"), F.lit(1).alias("kind"), F.lit("value").alias("value"))
    store.load(rows)
    store.flush()
    counts = [len(store.manifest.files)]
    for level in range(3):
        store.compact_range(level)
        counts.append(len(store.manifest.files))
    assert counts[0] == 4 and max(counts) == 4 and len(visible(store)) == 200


def test_a_flush_makes_files_for_what_is_left(spark, root, tmp_path):
    """Many versions of few keys: one file, not one for each file_bytes of the log; nothing else stays."""
    store = Store.open(spark, root, Options(file_bytes=1000))
    rows = spark.range(1000).select(F.col("id").alias("op_index"), F.format_string("k%02d", F.col("id") % 40).alias("key"), F.lit(1).alias("kind"), F.lit("value").alias("value"))
    store.load(rows)
    store.flush()
    assert [f.entries for f in store.manifest.files] == [40] and len(visible(store)) == 40
    assert {p.name for p in (tmp_path / "db" / "data").iterdir()} == {"L0"}
