"""Bloom filters as tables of bitmaps: (file_number, m, k, key_count, bucket, words).

A filter's m bits lie in buckets of equal size, BUCKET_BITS at most. A key's hash chooses its
bucket, and its k positions lie in that bucket, from double hashing, so k is free of the
number of hash functions. words is array<long>, bit p of the bucket in word p / 64. A key is
one row when a filter is built or probed, whatever k is: rows are dealt by (file, bucket), so
a file with most of all keys is many groups, and set bits and probes never travel one by one.

Hashes are Spark's 64-bit ones, or with portable=True the first 60 bits of MD5 of the key as
text, which other engines have too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sizing
from tidemark.operators.levels import near_ranges

BUCKET_BITS = 1 << 15
SHAPE = ["file_number", "m", "k", "key_count"]


def hashed(key: Column, number: int, portable: bool = False) -> Column:
    """The number-th hash of a key, of three."""
    if portable:
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{number}:"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.xxhash64(key, F.lit(number)) if number else F.xxhash64(key)


def buckets_of(m: Column) -> Column:
    return F.ceil(m / BUCKET_BITS).cast("long")


def bucket_bits(m: Column) -> Column:
    return F.ceil(m / buckets_of(m)).cast("long")


def _hashes(key: Column, portable: bool) -> list[Column]:
    return [hashed(key, i, portable) for i in range(3)]


def _bases(hashes: list[Column], m: Column) -> list[Column]:
    """bucket, first, step, size: position i of the key in its bucket is (first + i * step) mod
    size; reduced before they are added, so that nothing overflows."""
    size = bucket_bits(m)
    step = F.pmod(hashes[1], F.greatest(size - 1, F.lit(1).cast("long"))) + 1
    return [F.pmod(hashes[2], buckets_of(m)).alias("bucket"), F.pmod(hashes[0], size).alias("first"), step.alias("step"), size.alias("size")]


def _positions(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, and a row for each of a key's k positions `at`; never shuffled so."""
    numbered = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)).alias("i"))
    return numbered.select(*keep, F.pmod(F.col("first") + F.col("i") * F.col("step"), F.col("size")).alias("at"))


def parameters(keys: DataFrame, p: float = sizing.FALSE_POSITIVES) -> DataFrame:
    """(file_number, key_count, m, k) by the number of keys of each file."""
    sized = keys.groupBy("file_number").agg(F.count("*").alias("key_count"))
    sized = sized.withColumn("m", sizing.bloom_bits(F.col("key_count"), F.lit(p)))
    return sized.withColumn("k", sizing.bloom_hashes(F.col("key_count"), F.col("m")))


def packed(bits: DataFrame) -> DataFrame:
    """The table of bitmaps from rows (file_number, m, k, key_count, bit), a row a set bit;
    a table of bitmaps as it is."""
    if "bit" not in bits.columns:
        return bits
    size = bucket_bits(F.col("m"))
    rows = bits.select(*SHAPE, F.floor(F.col("bit") / size).cast("long").alias("bucket"), (F.col("bit") % size).alias("at"))
    return _dense(_words(rows), bits.select(*SHAPE).distinct())


def _words(rows: DataFrame) -> DataFrame:
    """(*SHAPE, bucket, word, bits) of rows (*SHAPE, bucket, at); where those of a bucket lie
    together already, without a shuffle."""
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    return rows.groupBy("file_number", "bucket", "m", "k", "key_count", F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _dense(words: DataFrame, shapes: DataFrame) -> DataFrame:
    """Bitmaps of all buckets of the filters, from the words that are not 0."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    zeros = shapes.select(*SHAPE, upto(buckets_of(F.col("m"))).alias("bucket")).select("*", upto(F.ceil(bucket_bits(F.col("m")) / 64).cast("long")).alias("word"), F.lit(0).cast("long").alias("bits"))
    dealt = words.unionByName(zeros).repartition("file_number", "bucket")
    every = dealt.groupBy("file_number", "bucket", "m", "k", "key_count", "word").agg(F.bit_or("bits").alias("bits"))
    held = every.groupBy("file_number", "bucket", "m", "k", "key_count").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return held.select(*SHAPE, "bucket", F.col("held.bits").alias("words"))


def build(keys: DataFrame, p: float = sizing.FALSE_POSITIVES, portable: bool = False) -> DataFrame:
    """keys: (file_number, key). One shuffle of the keys, and one of the filters' words."""
    return build_sized(keys, parameters(keys, p), portable)


def build_sized(keys: DataFrame, shapes: DataFrame, portable: bool = False) -> DataFrame:
    """The same for filters of stated sizes: shapes (*SHAPE)."""
    named = [f"_hash{i}" for i in range(3)]
    hashes = keys.select("file_number", *(h.alias(n) for h, n in zip(_hashes(F.col("key"), portable), named, strict=True)))  # before the join, which few tasks may do
    dealt = hashes.join(shapes, "file_number").select(*SHAPE, *_bases([F.col(n) for n in named], F.col("m"))).repartition("file_number", "bucket")
    return _dense(_words(_positions(dealt, *SHAPE, "bucket")), shapes)


def may_contain(filters: DataFrame, probes: DataFrame, portable: bool = False) -> DataFrame:
    """(file_number, key, maybe) for probes (file_number, key), each once; an absent filter
    holds nothing."""
    filters = packed(filters)
    asked = probes.select("file_number", "key").distinct().join(filters.where("bucket = 0").select("file_number", "m"), "file_number", "left")
    return _answered(filters, asked, _hashes(F.col("key"), portable))


def may_contain_near(filters: DataFrame, keys: DataFrame, files: DataFrame, portable: bool = False) -> DataFrame:
    """The same for each of the distinct keys (key) and the files whose range holds it. A key is
    hashed once, not for each file."""
    filters = packed(filters)
    named = [f"_hash{i}" for i in range(3)]
    hashes = keys.select("key", *(h.alias(n) for h, n in zip(_hashes(F.col("key"), portable), named, strict=True)))
    sized = files.select("file_number", "smallest", "largest").join(filters.where("bucket = 0").select("file_number", "m"), "file_number", "left")
    return _answered(filters, near_ranges(hashes, sized, (*named, "m")), [F.col(n) for n in named])


def _answered(filters: DataFrame, asked: DataFrame, hashes: list[Column]) -> DataFrame:
    """(file_number, key, maybe) of asked (file_number, key, m, and what hashes name). A probe
    is one row all the way; its positions are looked at until one isn't set."""
    bucket, first, step, _ = _bases(hashes, F.col("m"))
    dealt = asked.select("file_number", "key", F.coalesce(bucket, F.lit(0).cast("long")).alias("bucket"), first, step)
    met = dealt.join(filters.select("file_number", "bucket", "m", "k", "words"), ["file_number", "bucket"], "left")
    at = lambda i: F.pmod(F.col("first") + i * F.col("step"), bucket_bits(F.col("m")))
    bit = lambda p: F.call_function("bit_get", F.get("words", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int"))
    found = F.forall(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1), lambda i: bit(at(i)) == 1)
    return met.select("file_number", "key", F.coalesce(found, F.lit(False)).alias("maybe"))


def merge(filters: DataFrame, into: int) -> DataFrame:
    """One filter with the bits of all, word by word; fails where sizes differ."""
    held = packed(filters)
    shapes = held.select(*SHAPE).distinct().agg(F.min("m").alias("m"), F.max("m").alias("m2"), F.min("k").alias("k"), F.max("k").alias("k2"), F.sum("key_count").alias("key_count"))
    same = (F.col("m") == F.col("m2")) & (F.col("k") == F.col("k2"))
    checked = shapes.select(F.when(same, F.col("m")).otherwise(F.raise_error(F.lit("filters of different sizes can't be merged")).cast("long")).alias("m"), "k", "key_count")
    words = held.select("bucket", F.posexplode("words").alias("word", "bits")).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    merged = words.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held")).select("bucket", F.col("held.bits").alias("words"))
    return merged.join(F.broadcast(checked)).select(F.lit(into).alias("file_number"), "m", "k", "key_count", "bucket", "words")  # one row


def cleared(filters: DataFrame) -> DataFrame:
    """Filters of the same sizes without keys."""
    none = F.array_repeat(F.lit(0).cast("long"), F.size("words"))
    return packed(filters).select("file_number", "m", "k", F.lit(0).cast("long").alias("key_count"), "bucket", none.alias("words"))


#: By how much of its bits, or how many hashes, a filter's sizes may be off.
OFF_BITS, OFF_HASHES = 0.2, 2


def needs_resize(filters: DataFrame, p: float) -> DataFrame:
    """(file_number, m, k, key_count, new_m, new_k, resize): is the filter's size far from that
    for its keys at the error p? Never so for a filter without keys."""
    shapes = packed(filters).select(*SHAPE).distinct()
    sized = shapes.withColumn("new_m", sizing.bloom_bits(F.col("key_count"), F.lit(p)))
    sized = sized.withColumn("new_k", sizing.bloom_hashes(F.col("key_count"), F.col("new_m")))
    off = (F.abs(F.col("new_m") - F.col("m")) > OFF_BITS * F.col("m")) | (F.abs(F.col("new_k") - F.col("k")) > OFF_HASHES)
    return sized.withColumn("resize", (F.col("key_count") > 0) & off)


def optimize(filters: DataFrame, keys: DataFrame, p: float = sizing.FALSE_POSITIVES, portable: bool = False) -> DataFrame:
    """filters, those that need a resize built anew from keys (file_number, key) for the error p."""
    sizes = needs_resize(filters, p).where("resize").select("file_number", "key_count", F.col("new_m").alias("m"), F.col("new_k").alias("k"))
    left = packed(filters).join(sizes.select("file_number"), "file_number", "left_anti")
    anew = build_sized(keys.select("file_number", "key").distinct(), sizes, portable)
    return left.select(*SHAPE, "bucket", "words").unionByName(anew)


def serialize(filters: DataFrame) -> DataFrame:
    """(file_number, bucket, data): per bucket big-endian m u64, k u32, keys u64, then the words."""
    head = F.concat(F.lpad(F.hex("m"), 16, "0"), F.lpad(F.hex(F.col("k").cast("long")), 8, "0"), F.lpad(F.hex("key_count"), 16, "0"))
    words = F.array_join(F.transform("words", lambda w: F.lpad(F.hex(w), 16, "0")), "")
    return packed(filters).select("file_number", "bucket", F.unhex(F.concat(head, words)).alias("data"))


def deserialize(stored: DataFrame) -> DataFrame:
    """The filter table again."""
    number = lambda at, size: F.conv(F.hex(F.substring("data", at, size)), 16, -10).cast("long")
    n = ((F.length("data") - 20) / 8).cast("int")
    signed = lambda i: F.conv(F.hex(F.substring(F.col("data"), 21 + 8 * i, F.lit(8))), 16, -10).cast("long")
    return stored.select("file_number", number(1, 8).alias("m"), number(9, 4).cast("int").alias("k"), number(13, 8).alias("key_count"), "bucket", F.transform(F.sequence(F.lit(0), n - 1), signed).alias("words"))


def stats(filters: DataFrame) -> DataFrame:
    """(total_filters, total_memory_bytes, average_fp_rate, memory_per_filter)."""
    shapes = filters.select(*SHAPE).distinct()
    error = sizing.bloom_error(F.col("key_count"), F.col("m"), F.col("k"))
    sums = shapes.agg(F.count("*").alias("total_filters"), F.sum(sizing.bloom_memory(F.col("m"))).alias("total_memory_bytes"), F.round(F.avg(error), 9).alias("average_fp_rate"))
    return sums.withColumn("memory_per_filter", F.expr("total_memory_bytes div total_filters"))


def pruned(filters: DataFrame, files: DataFrame, keys: DataFrame, portable: bool = False) -> DataFrame:
    """(key, file_number): files a point read must open, by range and then by filter."""
    return may_contain_near(filters, keys.select("key").distinct(), files, portable).where("maybe").select("key", "file_number")
