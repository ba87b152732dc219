"""Benchmark decontamination by spaced-seed hashing.

MASKS are fixed patterns of a window's word positions: each ignores two of SPAN, so a hash is
that of the six words left, and substituted words spoil only windows in which they are looked
at. The first WIDE masks have their ignored words at every distance there is; an item of ALL_PAIRS
words or more, which has room for a window to slide, is hashed by these, a shorter one by all
28, so that no two substitutions in eight words hide it. Items under SPAN words have one
hash, of all their words. Hashes of all document windows meet those of the benchmark in a join;
a Bloom filter of BLOOM_BITS bits, a fixed size, spares the join those that cannot match.

Document and item of a hit are then laid along every diagonal on which they have one; the best
stretch (a match counts 1, a substitution -2) must hold MIN_MATCHED equal words, or MIN_SHARE
of a shorter item, or all of an item under SPAN words. A diagonal is as long as the item, so
this is work in proportion to the text; the words of text and item travel once for each
(text, item), however many hits they have.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters.
Defined cases: null and empty texts leak nothing; items under MIN_ITEM words say too little to
be a passage (they would take every document that has a common word) and are never reported;
repeated items are reported each; repeated documents each count under their doc_id, rows
without doc_id under their text; of equally good stretches the first in the document, then in
the item, is reported; whole texts of any length are hashed, in runs of GROUP texts or one long
one; other columns, whatever their names, are only passed on; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, reach_workers, rows_of, stage, texts, unused, whole_text
from tidemark.llm.words import Joined, multipliers, scramble

SPAN = 8
#: The two positions of a window that a mask ignores: first one pair of each distance (two of the
#: two least), then all other pairs.
_FIRST = ((3, 5), (2, 4), (1, 6), (6, 7), (0, 1), (2, 6), (2, 5), (1, 7), (0, 7))
MASKS = _FIRST + tuple(p for p in combinations(range(SPAN), 2) if p not in _FIRST)
WIDE = len(_FIRST)
ALL_PAIRS = 2 * SPAN
MIN_ITEM = 4
MIN_MATCHED = 13
MIN_SHARE = 0.75
#: Words kept on either side of a hit for its verification.
REACH = 32
BLOOM_BITS = 1 << 24
PROBES = 3
#: Texts a numpy call serves, and words compared by one.
GROUP, CELLS = 200, 1 << 20

_WEIGHTS = multipliers(SPAN, seed=3)
_TAGS = multipliers(len(MASKS) + SPAN, seed=5)
#: Hashes of whole items of n words have tag WHOLE + n.
WHOLE = len(MASKS) - 1

_SEEDS = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.list_(pa.int32()))]))
_ITEM = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", _SEEDS), ("tags", pa.list_(pa.int32()))])
_SEGMENT = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("content", pa.int64()), ("begin", pa.int64()), ("words", pa.list_(pa.int64())), ("hits", _SEEDS)])
_NAMES = ("doc_id", "content", "item_id", "doc_start", "item_start", "length", "matched", "item_words")
_FOUND = pa.schema([(n, pa.int64()) for n in _NAMES])
SEEDS = "array<struct<hash: long, at: array<int>>>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _seeds(joined: Joined, tags: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each tag, a mask's number or WHOLE + n: (places, hashes) of the windows within one text."""
    if any(t <= WHOLE for t in tags):
        n = max(0, len(joined.hashes) - SPAN + 1)
        within = np.flatnonzero(joined.owner[:n] == joined.owner[SPAN - 1 :][:n])
        weighed = [(joined.hashes[i : i + n] * w)[within] for i, w in enumerate(_WEIGHTS)]
        every = sum(weighed[1:], weighed[0])
    for tag in tags:
        if tag <= WHOLE:
            a, b = MASKS[tag]
            yield within, scramble(every - weighed[a] - weighed[b] + _TAGS[tag])
        else:
            size = tag - WHOLE
            at, h = joined.windows(tuple(range(size)), size, seed=40 + size)
            yield at, h


def tags_of(size: int) -> list[int]:
    """The masks, or the whole, that an item of so many words is hashed by."""
    if size < SPAN:
        return [WHOLE + size] if size >= MIN_ITEM else []
    return list(range(WIDE if size >= ALL_PAIRS else len(MASKS)))


def _by_hash(at: np.ndarray, h: np.ndarray) -> list[dict]:
    """[{hash, at: its places}], each hash once."""
    order = np.lexsort((at, h))
    at, h = at[order].astype(np.int32), h[order]
    cut = np.flatnonzero(h[1:] != h[:-1]) + 1
    firsts = np.concatenate([[0], cut]).astype(np.int64) if len(h) else []
    return [{"hash": x, "at": p} for x, p in zip(_signed(h[firsts]).tolist(), np.split(at, cut), strict=True)] if len(h) else []


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for item_id, text in rows_of(batch, "item_id", "text"):
            joined = Joined([text])
            if tags := tags_of(len(joined.hashes)):
                found = list(_seeds(joined, tags))
                at, h = (np.concatenate(x) for x in zip(*found, strict=True))
                out.append({"item_id": item_id, "words": _signed(joined.hashes), "seeds": _by_hash(at, h), "tags": tags})
        yield pa.RecordBatch.from_pylist(out, schema=_ITEM)


def _probes(h: np.ndarray, k: int) -> np.ndarray:
    return (scramble(h + np.uint64(k)) if k else h) & np.uint64(BLOOM_BITS - 1)


def _bloom(seeds: DataFrame) -> np.ndarray:
    """The filter's 64-bit cells: BLOOM_BITS bits, however many seeds there are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("hash").to_numpy().view(np.uint64)
            p = np.concatenate([_probes(h, k) for k in range(PROBES)]).astype(np.int64)
            yield pa.record_batch([pa.array(p >> 6), pa.array(np.left_shift(np.int64(1), p & 63))], names=["cell", "bit"])

    cells = np.zeros(BLOOM_BITS // 64, np.uint64)
    for cell, bits in seeds.select("hash").mapInArrow(places, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit")).toLocalIterator():
        cells[cell] = np.int64(bits).view(np.uint64)
    return cells


def _passing(joined: Joined, tags: list[int], bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, spans) of the windows that the filter lets through."""
    places, kept, spans = [], [], []
    for tag, (at, h) in zip(tags, _seeds(joined, tags), strict=True):
        for k in range(PROBES):
            p = _probes(h, k)
            hit = np.flatnonzero((bloom[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1))
            at, h = at[hit], h[hit]
        places.append(at)
        kept.append(h)
        spans.append(np.full(len(at), SPAN if tag <= WHOLE else tag - WHOLE))
    return np.concatenate(places), np.concatenate(kept), np.concatenate(spans)


def _segments(batches: Iterator[pa.RecordBatch], bloom: np.ndarray, tags: list[int]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for whole in batches:
        for start in range(0, whole.num_rows, GROUP):
            part = whole.slice(start, GROUP)
            ids, contents, joined, out = part.column("doc_id").to_pylist(), part.column("content").to_pylist(), Joined(part.column("text").to_pylist()), []
            at, h, spans = _passing(joined, tags, bloom)
            order = np.argsort(at, kind="stable")
            at, h, spans = at[order], h[order], spans[order]
            cut = np.flatnonzero((np.diff(at) > 2 * REACH) | (np.diff(joined.owner[at]) != 0)) + 1
            for places, hashes, sizes in zip(np.split(at, cut), np.split(h, cut), np.split(spans, cut), strict=True) if len(at) else ():
                doc = joined.owner[places[0]]
                begin = max(joined.starts[doc], places[0] - REACH)
                end = min(joined.ends[doc], (places + sizes).max() + REACH)
                out.append({"uid": uid, "doc_id": ids[doc], "content": contents[doc], "begin": int(begin - joined.starts[doc]), "words": _signed(joined.hashes[begin:end]), "hits": _by_hash(places - begin, hashes)})
                uid += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT)


def needed(size: int) -> int:
    """Equal words that a stretch must hold against an item of so many words."""
    return size if size < SPAN else min(MIN_MATCHED, int(np.ceil(MIN_SHARE * size)))


def best_on_diagonals(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int, int]:
    """(matches, start in words, start in item, length) of the best stretch on any diagonal: most
    matches, then first in the words, then in the item. A stretch is its diagonal's greatest
    sum of 1 a match, -2 a miss."""
    best, places = None, np.arange(len(item))
    step = max(1, CELLS // len(item))
    for first in range(0, len(diagonals), step):
        d = diagonals[first : first + step]
        at = d[:, None] + places
        equal = (words[np.clip(at, 0, len(words) - 1)] == item) & (at >= 0) & (at < len(words))
        sums = np.zeros((len(d), len(item) + 1), np.int32)
        np.cumsum(np.where(equal, 1, -2), axis=1, out=sums[:, 1:])
        low = np.minimum.accumulate(sums, axis=1)
        end = (sums - low).argmax(axis=1)
        start = (sums == low[np.arange(len(d)), end][:, None]).argmax(axis=1)
        counts = np.concatenate([np.zeros((len(d), 1), np.int32), np.cumsum(equal, axis=1, dtype=np.int32)], axis=1)
        matched = counts[np.arange(len(d)), end] - counts[np.arange(len(d)), start]
        k = np.lexsort((start, d + start, -matched))[0]
        found = (-int(matched[k]), int(d[k] + start[k]), int(start[k]), int(end[k] - start[k]))
        best = found if best is None else min(best, found)
    return -best[0], *best[1:]


def diagonals_of(hits: list[dict], n: int, m: int) -> np.ndarray:
    """The distinct diagonals of hits (at in a text of n words, item_at in an item of m words)."""
    seen = np.zeros(n + m + 1, bool)
    for hit in hits:
        at = np.array(hit["at"], np.int64) + m
        for place in hit["item_at"]:
            seen[at - place] = True
    return np.flatnonzero(seen) - m


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, content, begin, words, item_id, item, hits in rows_of(batch, "doc_id", "content", "begin", "words", "item_id", "item", "hits"):
            words, item = np.array(words), np.array(item)
            matched, start, item_start, length = best_on_diagonals(words, item, diagonals_of(hits, len(words), len(item)))
            if matched >= needed(len(item)):
                out.append((doc_id, content, item_id, begin + start, item_start, length, matched, len(item)))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_FOUND)


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What leaks() returns, with content: a row's text for rows without doc_id, else null."""
    reach_workers(docs.sparkSession)
    items = stage(benchmark.select("item_id", whole_text().alias("text")).mapInArrow(_items, f"item_id long, words array<long>, seeds {SEEDS}, tags array<int>"), "items")
    numbered = stage(items.select(F.monotonically_increasing_id().alias("item"), "*"), "numbered")
    tags = sorted(r[0] for r in numbered.select(F.explode("tags")).distinct().collect())  # at most len(_TAGS) numbers
    seeds = numbered.select("item", F.explode("seeds").alias("s")).select("item", F.col("s.hash").alias("hash"), F.col("s.at").alias("item_at"))
    find = partial(_segments, bloom=_bloom(seeds), tags=tags)
    content = F.when(F.col("doc_id").isNull(), F.xxhash64(whole_text())).alias("content")
    own = texts(docs, content) if tags else texts(docs, content).limit(0)
    segments = stage(own.mapInArrow(find, f"uid long, doc_id long, content long, begin long, words array<long>, hits {SEEDS}"), "segments")
    hits = segments.select("uid", F.explode("hits").alias("h")).select("uid", F.col("h.hash").alias("hash"), F.col("h.at").alias("at"))
    met = hits.join(seeds, "hash").groupBy("uid", "item").agg(F.collect_list(F.struct("at", "item_at")).alias("hits"))
    laid = met.join(segments.drop("hits"), "uid").join(numbered.select("item", "item_id", F.col("words").alias("item_list")), "item")
    laid = laid.select("doc_id", "content", "begin", "words", "item_id", F.col("item_list").alias("item"), "hits")
    found = laid.mapInArrow(_verified, ", ".join(f"{n} long" for n in _NAMES))
    best = F.max_by(F.struct(*_NAMES[3:]), F.struct("matched", -F.col("doc_start"), -F.col("item_start")))
    return found.groupBy("doc_id", "content", "item_id").agg(best.alias("b")).select("doc_id", "content", "item_id", "b.*")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item that share a passage, with its longest stretch in words."""
    return _leaks(docs, benchmark).drop("content")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no passage with the benchmark; all their columns. A doc_id goes
    with all its rows, a row without one by its own text."""
    of_id, of_content = unused(docs, "leaked_id", "leaked_content")
    leaked = stage(_leaks(docs, benchmark).select(F.col("doc_id").alias(of_id), F.col("content").alias(of_content)).distinct(), "leaked")
    content = F.when(F.col("doc_id").isNull(), F.xxhash64(whole_text()))
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col(of_id)) & content.eqNullSafe(F.col(of_content)), "left_anti").select(*quoted(docs))
