"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: rounds i = 0, 1, ... place every shingle in a hashed bin and keep the least hash of
each bin that no earlier round filled; from round t on, round i puts every shingle in bin
i - t, so each of the t coordinates is filled, after one round for all but short texts. The
chance that two sketches agree at a coordinate is the Jaccard similarity, with the
concentration of t independent MinHashes, at a cost of O(n + t log t) a text.

Banding: BANDS keys of ROWS coordinates. A pair at similarity 0.75 shares no key with
probability (1 - 0.75 ** ROWS) ** BANDS, about 5e-6.

Links: texts with equal shingle sets are one node (digest of the set). First every member
of a bucket is compared with the bucket's least member, and components are formed. Where a
bucket then still holds several components, its pairs across components are compared: in
buckets of at most SMALL members pair by pair; in larger ones each outsider is laid against
the bucket's most frequent component and against the other outsiders, block by block, so
that no row is made for a pair that isn't linked. Every pair that shares a key is thus
either compared on the full sets or joined already: nothing is capped.

Defined cases: null and empty texts have no shingles, are linked with nothing and kept;
fewer than five words are one shingle; rows that share a doc_id are one document; rows
without doc_id get component null and are kept; of rows that share a doc_id the one with the
least text, and of these with the least JSON, stays in distinct_documents; texts are sketched
and compared whole, however long; other columns, whatever their names, are only passed on. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filtered_joins, quoted, rows_of, scratch, stage, texts
from tidemark.llm.graph import components
from tidemark.llm.words import combine, hash_words, multipliers, scramble, spaced_words

SHINGLE_WORDS = 5
ROWS, BANDS = 5, 45
COORDINATES = ROWS * BANDS
#: Linked when SIMILAR[1] * intersection >= SIMILAR[0] * union.
SIMILAR = (75, 100)
#: Buckets up to this many members are compared pair by pair: work in proportion to members.
SMALL = 32
#: Sets laid against each other in one task's numpy calls, on either side.
LEFT_BLOCK, RIGHT_BLOCK = 256, 1024

_SEEDS = multipliers(2 * COORDINATES, seed=7)
_EMPTY = np.uint64(2**64 - 1)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles."""
    words = hash_words(spaced_words(text))
    span = min(SHINGLE_WORDS, len(words))
    if not span:
        return words
    return np.unique(combine(words, tuple(range(span)), span, seed=span))


def sketch(found: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates for a non-empty array of distinct hashes."""
    out = np.full(t, _EMPTY)
    for i, seed in enumerate(_SEEDS[: 2 * t]):
        h = scramble(found * seed)
        if i >= t:
            if out[i - t] == _EMPTY:
                out[i - t] = h.min()
            continue
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        if i:
            free = (out == _EMPTY)[bins]
            h, bins = h[free], bins[free]
        np.minimum.at(out, bins, h)
        if out.max() != _EMPTY:
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    keys = (coordinates.reshape(BANDS, ROWS) * multipliers(ROWS, seed=11)).sum(axis=1, dtype=np.uint64)
    return scramble(keys + multipliers(BANDS, seed=13)).view(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.empty(0, np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            ids, sizes, digests, bands = [], [], [], []
            for doc_id, text in rows_of(whole.slice(at, 1000), "doc_id", "text"):
                found = shingles(text)
                ids.append(doc_id)
                sizes.append(len(found))
                digests.append(blake2b(found, digest_size=16).digest() if len(found) else None)
                bands.append(band_keys(sketch(found)) if len(found) else none)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(bands)], schema=_SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            rows = list(rows_of(whole.slice(at, 500), "doc_id", "text"))
            yield pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), _lists([shingles(t) for _, t in rows])], schema=_SETS)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    of = lambda end: sets.select(F.col("id").alias(end), F.col("shingles").alias(f"set_{end}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.join(of("b"), "b").join(of("a"), "a").where(both * SIMILAR[1] >= union * SIMILAR[0]).select(F.col("b").alias("u"), F.col("a").alias("v"))


def _similar_size(n: str | Column, m: str | Column) -> Column:
    return F.least(n, m) * SIMILAR[1] >= F.greatest(n, m) * SIMILAR[0]


def similar_rows(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each left set, the right sets that are similar enough, by an inverted index."""
    sizes = np.array([len(x) for x in right])
    values, word = np.unique(np.concatenate(right), return_inverse=True)
    order = np.argsort(word, kind="stable")
    posting = np.repeat(np.arange(len(right)), sizes)[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(values)))])
    for i, found in enumerate(left):
        at = np.searchsorted(values, found)
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == found)]
        if not len(at):
            continue
        lengths = ends[at + 1] - ends[at]
        places = np.arange(lengths.sum()) + np.repeat(ends[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        both = np.bincount(posting[places], minlength=len(right))
        hit = np.flatnonzero(both * SIMILAR[1] >= (len(found) + sizes - both) * SIMILAR[0])
        if len(hit):
            yield i, hit


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the rows with side 0 and those with side 1, of different labels."""
    side, ids, labels = (table.column(c).to_numpy() for c in ("side", "id", "label"))
    lists = table.column("shingles").combine_chunks()
    values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    u, v = [], []
    if len(left) and len(right):
        of = lambda rows: [values[ends[i] : ends[i + 1]] for i in rows]
        for i, hit in similar_rows(of(left), of(right)):
            hit = right[hit]
            hit = hit[labels[hit] != labels[left[i]]]
            if len(hit):  # one link to each component is enough
                hit = hit[np.unique(labels[hit], return_index=True)[1]]
                u += [ids[left[i]]] * len(hit)
                v += ids[hit].tolist()
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_LINKS)


def _laid_out(left: DataFrame, right: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the left and right rows (g, id, label) of equal g, in blocks of bounded size."""

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("g").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    counts = stage(blocks(left, LEFT_BLOCK, "n_left").join(blocks(right, RIGHT_BLOCK, "n_right"), "g"), "blocks")
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(counts, "g").withColumn("x", number("n_left")).select("g", "x", all_of("n_right").alias("y"), F.lit(0).alias("side"), "id", "label")
    b = right.join(counts, "g").withColumn("y", number("n_right")).select("g", all_of("n_left").alias("x"), "y", F.lit(1).alias("side"), "id", "label")
    laid = a.unionByName(b).join(sets, "id").select("g", "x", "y", "side", "id", "label", "shingles")
    return laid.groupBy("g", "x", "y").applyInArrow(_block_links, "u long, v long")


def _across(entries: DataFrame, sets: DataFrame, laid_out: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Links between members (key, id, n, label) of one bucket whose labels differ."""
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "size")
    sizes = stage(sizes, "sizes")
    mixed = stage(entries.join(sizes, "key"), "mixed")
    small = mixed.where(F.col("size") <= SMALL)
    other = small.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"))
    pairs = small.join(other, "key").where((F.col("id") < F.col("b")) & (F.col("label") != F.col("other")) & _similar_size("n", "m"))
    links = _linked(pairs.select(F.col("id").alias("a"), "b").distinct(), sets)
    large = mixed.where(F.col("size") > SMALL)
    if large.isEmpty():
        return links
    homes = large.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("home"))
    outside = stage(large.join(homes, "key").where("label <> home").select("key", "home", "id", "label"), "outside")
    at_home = outside.select(F.col("home").alias("g"), "id", "label").distinct()
    members = large.select(F.col("label").alias("g"), "id", "label").distinct().join(outside.select(F.col("home").alias("g")).distinct(), "g", "left_semi")
    among = outside.select(F.col("key").alias("g"), "id", "label")
    return links.unionByName(laid_out(at_home, members, sets)).unionByName(laid_out(among, among, sets))


def linked_components(entries: DataFrame, sets: DataFrame, laid_out: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = _laid_out) -> DataFrame | None:
    """(u, v), each node but the least of its component and that least one, for the members
    (key, id, n) of buckets and their sets (id, shingles); None where there are no members.
    laid_out finds the links of large buckets."""
    if entries.isEmpty():
        return None
    # written, so that the join has no aggregation in its stage and a hot band key can be split
    pivots = stage(entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p")).select("key", F.col("p.id").alias("pid"), F.col("p.n").alias("pn")), "pivots")
    pairs = entries.join(pivots, "key").where((F.col("id") != F.col("pid")) & _similar_size("n", "pn")).select(F.col("pid").alias("a"), F.col("id").alias("b")).distinct()
    stars = components(_linked(pairs, sets))
    rest = entries.join(pivots.select("key", F.col("pid").alias("id")), ["key", "id"], "left_anti")
    rest = rest.join(stars.select(F.col("u").alias("id"), "v"), "id", "left").select("key", "id", "n", F.coalesce("v", "id").alias("label"))
    return components(stars.unionByName(_across(stage(rest, "rest"), sets, laid_out)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    spark = docs.sparkSession
    own = texts(docs)
    sketched = stage(own.mapInArrow(_sketches, "doc_id long, n_shingles long, set_digest binary, bands array<long>"), "sketches")
    named = sketched.where("doc_id is not null and set_digest is not null")
    nodes = named.groupBy("set_digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = stage(nodes.select("id", "set_digest", "n", "bands"), "nodes")
    in_bands = nodes.select("id", "n", F.explode("bands").alias("key"))
    with filtered_joins(spark):
        shared = stage(in_bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"), "keys")
        entries = stage(in_bands.join(shared.where("low < high").select("key").hint("merge"), "key", "left_semi"), "entries")
        ids = stage(entries.select("id", "n").distinct(), "candidates")
        sets = stage(own.join(ids.where("n > 0").select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>"), "sets")

    stars = linked_components(entries, sets)
    first = nodes.select("set_digest", "id")
    if stars is not None:
        first = first.join(stars.select(F.col("u").alias("id"), "v"), "id", "left").select("set_digest", F.coalesce("v", "id").alias("first"))
    else:
        first = first.withColumnRenamed("id", "first")
    return (
        sketched.drop("bands").join(first, "set_digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def distinct_documents(docs: DataFrame, of_groups: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns. Rows that share a
    doc_id are one document, of which one row with the least text stays.

    of_groups: applied to the rows that stay of groups of two or more.
    """
    with scratch(docs.sparkSession) as keep:
        removed = keep(near_duplicates(docs).where(~F.col("kept")).select("doc_id", "component_id").distinct(), "near-removed")
    names = removed.select("doc_id")
    if of_groups is None:
        return _one_row_each(docs, docs.join(names.hint("merge"), "doc_id", "left_anti"))
    firsts = removed.groupBy(F.col("component_id").alias("doc_id")).agg(F.count("*").alias("n")).join(names, "doc_id", "left_anti")
    firsts = stage(firsts, "near-firsts")
    with filtered_joins(docs.sparkSession):  # only the texts of groups are shuffled
        first = stage(_one_row_each(docs, docs.join(firsts.where("n > 0").select("doc_id").hint("merge"), "doc_id", "left_semi")), "near-groups")
    rest = docs.join(names.unionByName(firsts.select("doc_id")).hint("merge"), "doc_id", "left_anti")
    return _one_row_each(docs, rest).unionByName(of_groups(first))


def _one_row_each(docs: DataFrame, left: DataFrame) -> DataFrame:
    """left, rows of docs, with one row a doc_id."""
    left = left.select(*quoted(docs))
    repeated = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if not repeated.isEmpty():
        row = F.struct(*quoted(docs))
        again = left.join(repeated, "doc_id", "left_semi").select(*quoted(docs))
        first = again.groupBy("doc_id").agg(F.min_by(row, F.struct(F.coalesce("text", F.lit("")), F.to_json(row))).alias("row"))
        left = left.join(repeated, "doc_id", "left_anti").select(*quoted(docs)).unionByName(first.select("row.*"))
    return left.select(*quoted(docs))
