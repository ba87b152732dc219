"""Word hashes on Python workers: one dictionary probe a word, numpy for all the rest."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries of a generation of a cache; bounds a worker's memory, never the results.
CACHE_WORDS = 150_000

MIX = np.uint64(0x9E3779B97F4A7C15)


class Remembered(dict):
    """key -> made(key), kept for two generations of `most` entries: what is in use survives."""

    def __init__(self, made, most: int = CACHE_WORDS):
        super().__init__()
        self.made, self.most, self.before = made, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


_USED: list[Remembered] = []


def in_use(cache: Remembered) -> None:
    """A worker serves one kind of task after another: only the last one's cache is kept."""
    if not _USED or _USED[0] is not cache:
        for other in _USED:
            other.clear()
            other.before = {}
        _USED[:] = [cache]


_HASHES = Remembered(xxhash.xxh3_64_intdigest)


def hash_words(words: list[bytes]) -> np.ndarray:
    in_use(_HASHES)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    """n odd 64-bit numbers from a seed."""
    return scramble(np.arange(seed << 32, (seed << 32) + n, dtype=np.uint64)) | np.uint64(1)


def combine(h: np.ndarray, offsets: tuple[int, ...], span: int, seed: int = 1) -> np.ndarray:
    """For each window of `span` words, a hash of the words at `offsets`, order included."""
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for m, o in zip(multipliers(len(offsets), seed), offsets, strict=True):
        out += h[o : o + n] * m
    return scramble(out)


#: ASCII letters and digits, and every byte of a non-ASCII character, are word bytes.
_ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def alnum_words(text: str) -> list[bytes]:
    """A-Z lower-cased, then runs of characters outside 00-2F, 3A-60, 7B-7F."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_ALNUM).split()


def spaced_words(text: str) -> list[bytes]:
    """A-Z lower-cased, then runs of characters other than space, tab, LF, VT, FF, CR."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Joined:
    """The word hashes of many texts in one array, so that numpy calls serve them all."""

    def __init__(self, texts: list[str]):
        words = [alnum_words(t) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.hashes = np.concatenate([hash_words(w) for w in words]) if words else np.empty(0, np.uint64)

    def windows(self, offsets: tuple[int, ...], span: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(places in the array, hashes) of the windows that lie within one text."""
        found = combine(self.hashes, offsets, span, seed)
        at = np.flatnonzero(self.owner[: len(found)] == self.owner[span - 1 :][: len(found)])
        return at, found[at]

    def places(self, words: list[str]) -> np.ndarray:
        """Where the words stand consecutively within one text."""
        n = len(self.hashes) - len(words) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        hit = np.flatnonzero(self.hashes[:n] == np.uint64(xxhash.xxh3_64_intdigest(words[0].encode())))
        for k, w in enumerate(words[1:], 1):
            hit = hit[self.hashes[hit + k] == np.uint64(xxhash.xxh3_64_intdigest(w.encode()))]
        return hit[self.owner[hit] == self.owner[hit + len(words) - 1]]
