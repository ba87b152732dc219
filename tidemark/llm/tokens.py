"""Whole-text encoding with the tokenizers library, remembered by run of letters.

The vocabulary's pre-tokenizer never lets a token cross white space, and within the Latin
blocks its split, lower-casing and NFC work character by character. So a text's ids are
the ids of its pieces, joined. Pieces with any character from U+0250 on, or U+0130, go to
the library whole. tests/llm compare with the library's ids for whole texts.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import regex

from tidemark.llm.words import Remembered, in_use

END_ID = 2
#: Entries of a generation; see words.Remembered.
CACHE_CHUNKS = 200_000
#: The pre-tokenizer's own split; fixed values of the vocabulary file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stay, the others go to U+0100 and on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 0x100 + i for i, b in enumerate(others)}


class Encoder:
    """Ids as little-endian uint32 bytes, remembered by chunk (the text between spaces). A
    chunk of several pre-tokens, or with capitals, is put together from chunks that are one
    pre-token in lower case, which share the memory."""

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.chunks = Remembered(self.chunk, remembered or CACHE_CHUNKS)
        self.marks = {mark: self.run(mark) for mark in ".,"}

    def run(self, run: str) -> bytes:
        """A pre-token in lower case, by the library's model."""
        plain = run.isascii() and run.isprintable()
        seen = run if plain else run.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(seen)])

    def chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if max(chunk) >= "ɐ" or "İ" in chunk or "<|" in chunk:  # İ in lower case is two characters
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        low = chunk.lower()
        if chunk.isalpha():
            return self.run(low) if low == chunk else self.chunks[low]
        mark = self.marks.get(chunk[-1])
        if mark and chunk[:-1].isalpha():
            return self.chunks[low[:-1]] + mark
        runs = SPLIT.findall(low)
        return self.run(low) if runs == [chunk] else b"".join(map(self.chunks.__getitem__, runs))

    def ids(self, text: str) -> bytes:
        """Every id of the whole text, without special tokens and without an end id."""
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def with_end(self, text: str) -> bytes:
        return self.ids(text) + END_ID.to_bytes(4, "little")


@functools.lru_cache(2)
def _loaded(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    found = _loaded(path)
    in_use(found.chunks)
    return found
