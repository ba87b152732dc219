"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut into pieces whose lengths are powers of two, the
binary digits of its length with as many pieces of the largest size as fit. Each piece is a
sequence of its own, so no sequence crosses documents and none needs padding; pieces of
equal length share a bucket, from which batches of one shape are drawn.

Defined cases: null or empty text is the end id alone, one piece of length 1; rows that
repeat, or share or lack a doc_id, are packed one by one; an empty table gives no rows.
No shuffle, one pass, memory for one document and one Arrow batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, texts
from tidemark.llm.tokens import default_path, encoder

#: The longest sequence; a power of two.
SEQUENCE_TOKENS = 4096

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, bucket int, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")] + [("bucket", pa.int32()), ("ids", pa.binary())])


def binary_lengths(n: int, most: int = SEQUENCE_TOKENS) -> list[int]:
    """n as pieces of `most`, then its remaining binary digits from the highest down."""
    digits = [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most & 1 << k]
    return [most] * (n // most) + digits


def _pieces(batches: Iterator[pa.RecordBatch], path: str, most: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).with_end
    for batch in batches:
        out = []
        for doc_id, text in rows_of(batch, "doc_id", "text"):
            ids = encode(text)
            start, total = 0, len(ids) // 4
            for length in binary_lengths(total, most):
                piece = ids[4 * start : 4 * (start + length)]
                out.append((doc_id, start, length, zlib.crc32(piece), total, 0, length.bit_length() - 1, piece if with_ids else None))
                start += length
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str | None = None, most: int = SEQUENCE_TOKENS, with_ids: bool = True) -> DataFrame:
    """A row per piece: its place in the document, its bucket (log2 of its length), its
    sequence and its ids (little-endian uint32; null without with_ids)."""
    cut = partial(_pieces, path=tokenizer or default_path(), most=most, with_ids=with_ids)
    return texts(docs).mapInArrow(cut, SCHEMA).withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder per bucket; every row in it has ids of one length."""
    packed.write.partitionBy("bucket").parquet(path)


def packed_rows(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What query op6 returns."""
    return pack(docs, tokenizer, with_ids=False).drop("ids")
