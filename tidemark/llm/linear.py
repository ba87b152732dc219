"""Hashed word features and numpy linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tidemark.llm.words import CACHE_WORDS, Remembered, alnum_words, in_use

#: Features; the size of a model, whatever the vocabulary.
BUCKETS = 1 << 22
#: A text's features are its words and, for words of one stem, the beginnings of these many
#: bytes that at least so many different words of the text have.
STEMS = (4, 5, 6)
SHARED = (2, 4)
GROUP = 200

FEATURES_SCHEMA = "doc_id long, buckets array<int>"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("buckets", pa.list_(pa.int32()))])
COUNTS_SCHEMA = "bucket int, texts long"
_COUNTS = pa.schema([("bucket", pa.int32()), ("texts", pa.int64())])
#: The bucket under which text_counts counts all texts, those without words too.
ALL_TEXTS = -1


def _buckets(word: bytes) -> bytes:
    parts = [word, *(word[:n] + b"-" if len(word) > n else b"-" for n in STEMS)]
    return b"".join((xxhash.xxh3_64_intdigest(x) % BUCKETS).to_bytes(4, "little") for x in parts)


_BUCKETS = Remembered(_buckets, CACHE_WORDS)


def _of_text(text: str) -> np.ndarray:
    """The distinct buckets of a whole text."""
    found = np.frombuffer(b"".join(map(_BUCKETS.__getitem__, set(alnum_words(text)))), "<u4").reshape(-1, 1 + len(STEMS))
    stems, counts = np.unique(found[:, 1:], return_counts=True)
    marked = [(stems[counts >= n] + np.uint32(n)) % np.uint32(BUCKETS) for n in SHARED]
    return np.unique(np.concatenate([found[:, 0], *marked]))


def distinct_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, buckets), each bucket once a text."""
    in_use(_BUCKETS)
    found = [_of_text(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    return doc, np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, GROUP):
            part = whole.slice(start, GROUP)
            doc, bucket = distinct_buckets(part.column("text").to_pylist())
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
            yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], schema=_FEATURES)


def text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each bucket is: at most BUCKETS + 1 rows a task."""
    counts, n = np.zeros(BUCKETS, np.int32), 0
    for whole in batches:
        for start in range(0, whole.num_rows, GROUP):
            part = whole.slice(start, GROUP)
            np.add.at(counts, distinct_buckets(part.column("text").to_pylist())[1], 1)
            n += part.num_rows
    yield pa.record_batch([pa.array([ALL_TEXTS], pa.int32()), pa.array([n], pa.int64())], schema=_COUNTS)
    held = np.flatnonzero(counts)
    for start in range(0, len(held), 1 << 16):
        some = held[start : start + (1 << 16)]
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], schema=_COUNTS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class Rows:
    """Sparse rows of ones, by numpy."""

    def __init__(self, lists: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.columns = np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(lists)), self.sizes)
        self.n = len(lists)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.columns], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, g[self.owner], minlength=size)
