"""Keys, records and formulas."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys, sizing
from tidemark.operators import bloom
from tidemark.sources import log_files, names


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_byte_order(spark):
    rows = [(bytes.fromhex(h),) for h in ("62", "6162", "ff", "61", "6100")]
    got = [r[0].hex() for r in spark.createDataFrame(rows, "key binary").orderBy("key").collect()]
    assert got == ["61", "6100", "6162", "62", "ff"]


def test_internal_key(spark):
    rows = [(b"", 0, 0), (b"a", 1, 1), (b"a\0", 2**40, 0), (b"\xff" * 9, 2**55 + 3, 1)]
    packed = one(spark, rows, "k binary, s long, d int", keys.encode_internal_key("k", "s", "d"))
    assert [bytes(p[0]) for p in packed] == [k + struct.pack(">Q", s << 8 | d) for k, s, d in rows]
    back = one(spark, [(bytes(p[0]),) for p in packed] + [(b"short",)], "i binary", keys.decode_internal_key("i").alias("d"))
    assert [(bytes(d.key), d.seq, d.kind) for (d,) in back[:-1]] == rows
    assert tuple(back[-1][0]) == (None, 0, 0)


def test_common_prefix_equal_and_compare(spark):
    rows = [(b"abc", b"abd"), (b"", b"a"), (b"ab", b"abc"), (b"x", b"y"), (None, None), (None, b"")]
    got = one(spark, rows, "a binary, b binary", keys.common_prefix("a", "b"), keys.equal("a", "b"), keys.compare("a", "b"))
    assert [g[0] for g in got[:4]] == [2, 0, 2, 0]
    assert [g[1] for g in got] == [False, False, False, False, True, False]
    assert [g[2] for g in got[:4]] == [-1, -1, -1, -1]
    assert one(spark, [(None,), (b"k",)], "a binary", keys.safe_string("a")) == [("<nil>",), ("k",)]


def test_log_record_equals_the_codec(spark):
    rows = [(1, 1, b"a", b"v"), (2**50, 0, b"key", b"ignored"), (7, 1, b"\0\xff", b""), (8, 1, b"n", None)]
    got = one(spark, rows, "s long, d int, k binary, v binary", keys.encode_log_record("s", "d", "k", "v"))
    assert [bytes(g[0]) for g in got] == [log_files.encode_record(*r) for r in rows]


def test_log_files(spark, tmp_path):
    ops = [(1, 1, b"a", b"1"), (2, 0, b"a", None), (3, 1, b"b", b"")]
    whole = log_files.header() + b"".join(log_files.encode_record(*o) for o in ops)
    (tmp_path / "LOG.1").write_bytes(whole)
    (tmp_path / "LOG.2").write_bytes(whole[:-3])  # torn: the last record is ignored
    (tmp_path / "LOG.3").write_bytes(log_files.header())
    got = log_files.read_logs(spark, str(tmp_path)).collect()
    by = {n: sorted((r.seq, r.kind, bytes(r.key), None if r.value is None else bytes(r.value)) for r in got if r.file.endswith(n)) for n in ("LOG.1", "LOG.2", "LOG.3")}
    assert by == {"LOG.1": ops, "LOG.2": ops[:2], "LOG.3": []}


@pytest.mark.parametrize("place, what", [(0, "magic"), (5, "version"), (17, "header's checksum"), (30, "wrong checksum")])
def test_damage_raises(place, what):
    data = bytearray(log_files.header() + log_files.encode_record(1, 1, b"key", b"value"))
    data[place] ^= 0x55
    with pytest.raises(log_files.LogCorrupted, match=what):
        list(log_files.decode_records(bytes(data)))
    with pytest.raises(log_files.LogCorrupted, match="cut off"):
        list(log_files.decode_records(b"\0" * 8))


def test_checksum_is_crc32(spark):
    assert one(spark, [(b"123456789",)], "b binary", F.crc32("b")) == [(zlib.crc32(b"123456789"),)]


def test_filter_sizes(spark):
    rows = [(1000, 0.01), (0, 0.01), (5, 0.0), (5, 1.0), (-1, 0.5)]
    got = one(spark, rows, "n long, p double", sizing.bloom_bits(F.col("n"), F.col("p")).alias("m"))
    assert [g[0] for g in got] == [9586, 1024, 1024, 1024, 1024]
    assert one(spark, [(1000, 9586), (0, 9586), (9, 0)], "n long, m long", sizing.bloom_hashes(F.col("n"), F.col("m"))) == [(7,), (4,), (4,)]
    assert one(spark, [(0, 64, 3)], "n long, m long, k int", sizing.bloom_error(F.col("n"), F.col("m"), F.col("k"))) == [(0.0,)]


def test_level_targets_and_modes(spark):
    got = one(spark, [(i,) for i in range(4)], "l int", sizing.level_target(F.col("l")))
    assert [g[0] for g in got] == [4 << 22, 10 << 22, 100 << 22, 1000 << 22]
    got = one(spark, [(0, 4, 50, 100, 48.0), (1, 0, 0, 100, 0.0)], "l int, n long, s long, t long, h double", sizing.compaction_priority(*map(F.col, "lnsth")).alias("p"))
    assert [round(g[0], 6) for g in got] == [0.8, 0.0]
    assert one(spark, [(0.8,), (0.5,), (0.3,)], "p double", sizing.compaction_mode(F.col("p"))) == [("aggressive",), ("standard",), ("lazy",)]


@pytest.fixture(scope="module")
def filters(spark):
    stored = spark.range(3000).select((F.col("id") % 3).alias("file_number"), F.col("id").alias("key"))
    return stored, bloom.build(stored).cache()


def test_no_false_negatives_and_few_false_positives(spark, filters):
    stored, built = filters
    assert bloom.may_contain(built, stored).where("not maybe").count() == 0
    absent = spark.range(10_000, 20_000).select(F.lit(1).cast("long").alias("file_number"), F.col("id").alias("key"))
    assert bloom.may_contain(built, absent).where("maybe").count() < 250


def test_filters_serialize(filters):
    _, built = filters
    back = bloom.deserialize(bloom.serialize(built))
    assert back.exceptAll(built.select(back.columns)).count() == 0 and back.count() == built.count()


def test_absent_filter_and_mismatch(spark, filters):
    _, built = filters
    nowhere = spark.createDataFrame([(99, 1)], "file_number long, key long")
    assert [r.maybe for r in bloom.may_contain(built, nowhere).collect()] == [False]
    rows = [(1, 64, 3, 5, 1), (2, 128, 3, 5, 1)]
    with pytest.raises(Exception, match="different sizes"):
        bloom.merge(spark.createDataFrame(rows, "file_number long, m long, k int, key_count long, bit long"), 0).collect()


def test_pruned_files_hold_every_key(spark, filters):
    stored, built = filters
    files = stored.groupBy("file_number").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"))
    found = bloom.pruned(built, files, stored.select("key"))
    assert stored.join(found, ["key", "file_number"], "left_anti").count() == 0
    assert found.count() < 1.2 * stored.count()


def test_names(spark):
    df = spark.createDataFrame([("LOG.3",), ("000010.log",), ("000010.sst",), ("LOG.x",), ("LOG.12",)], "name string")
    assert names.next_log(df).first()[0] == 13
    assert names.next_log(df.limit(0)).first()[0] == 1
    assert sorted(r.name for r in names.removable_logs(df, 1).collect()) == ["000010.log", "LOG.3"]
    assert [r[0] for r in spark.createDataFrame([(42,), (12345678,)], "n int").select(names.table_name(F.col("n"))).collect()] == ["000042.sst", "12345678.sst"]
