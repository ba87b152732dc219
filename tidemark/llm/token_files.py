"""Token ids as Arrow files of fixed-size-list batches.

Documents are dealt out by ranges of doc_id and sorted; each task streams its ids into one
Arrow IPC file (the stream format with a footer, so any batch can be reached directly):

    ids   fixed_size_list<uint16 or uint32>[sequence_tokens]   rows of the id stream
    mask  fixed_size_list<uint8>[sequence_tokens / 8]          a bit per id, 0 on padding

Every batch but the last holds BATCH_ROWS rows, so sequence i lies in batch i // BATCH_ROWS
and a memory-mapped reader returns views, not copies. Only the last row of a file is padded.
A second file beside it, `.docs`, lists (doc_id, start, n_tokens) within the file. Files of a
failed attempt are never named in the manifest, which is a written table.

Defined cases: null or empty text is the end id alone; rows with equal doc_id follow each
other by text; null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, qualified, rows_of, stage, texts
from tidemark.llm.tokens import default_path, encoder

SEQUENCE_TOKENS = 2048
BATCH_ROWS = 256

FILE_SCHEMA = "file string, part int, n_docs long, n_rows long, n_tokens long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length // 8))])


class Writer:
    """Gathers ids and writes full batches; holds one batch and one document."""

    def __init__(self, path: str, length: int, kind: pa.DataType):
        self.fs, place = pa.fs.FileSystem.from_uri(path)
        self.fs.create_dir(place.rpartition("/")[0], recursive=True)
        self.schema, self.length, self.kind = file_schema(length, kind), length, kind
        self.sink = self.fs.open_output_stream(place)
        self.docs_sink = self.fs.open_output_stream(f"{place}.docs")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.docs = pa.ipc.new_file(self.docs_sink, _DOCS)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_rows = self.n_docs = 0
        self.listed: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.listed.append((doc_id, self.n_tokens, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self.n_held >= self.length * BATCH_ROWS:
            self.flush(self.length * BATCH_ROWS)
        if len(self.listed) >= 10_000:
            self.list_docs()

    def flush(self, step: int) -> None:
        every = np.concatenate(self.held) if self.held else np.empty(0, self.kind.to_pandas_dtype())
        cut = len(every) - len(every) % step
        for at in range(0, cut, step):
            self.batch(every[at : at + step], step)
        self.held, self.n_held = [every[cut:]], len(every) - cut

    def batch(self, ids: np.ndarray, used: int) -> None:
        rows = len(ids) // self.length
        mask = np.packbits(np.arange(len(ids)) < used, bitorder="little")
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length // 8)], schema=self.schema))
        self.n_rows += rows

    def list_docs(self) -> None:
        if self.listed:
            self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.listed, strict=True)], schema=_DOCS))
            self.listed = []

    def close(self) -> None:
        rest = np.concatenate(self.held) if self.n_held else None
        if rest is not None:
            padded = np.zeros(-(-len(rest) // self.length) * self.length, rest.dtype)
            padded[: len(rest)] = rest
            self.batch(padded, len(rest))
        self.list_docs()
        for x in (self.file, self.sink, self.docs, self.docs_sink):
            x.close()


class TokenFile:
    """Random access to a written file; a local one is mapped, and what it gives are views."""

    def __init__(self, path: str):
        self.fs, self.place = pa.fs.FileSystem.from_uri(path)
        self.source = self._open(self.place)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def _open(self, place: str):
        return pa.memory_map(place) if isinstance(self.fs, pa.fs.LocalFileSystem) else self.fs.open_input_file(place)

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.reader.get_batch(k)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of row i, a view, and its mask as booleans."""
        k, r = divmod(i, BATCH_ROWS)
        row = self.batch(k).slice(r, 1)
        return row.column("ids").flatten().to_numpy(), np.unpackbits(row.column("mask").flatten().to_numpy(), bitorder="little").view(bool)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids start..start+n of the file's stream; a view where they lie in one batch."""
        step, parts = self.length * BATCH_ROWS, []
        while n > 0:
            k, at = divmod(start, step)
            part = self.batch(k).column("ids").flatten().to_numpy()[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        with self._open(f"{self.place}.docs") as source:
            docs = pa.ipc.open_file(source)
            for k in range(docs.num_record_batches):
                yield from rows_of(docs.get_batch(k), "doc_id", "start", "n_tokens")

    def close(self) -> None:
        self._batch = None
        self.source.close()


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, length: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    kind = pa.uint16() if encode.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
    part = TaskContext.get().partitionId()
    name, out = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow", None
    for batch in batches:
        for doc_id, text in rows_of(batch, "doc_id", "text"):
            out = out or Writer(name, length, kind)
            out.add(doc_id, np.frombuffer(encode.with_end(text), "<u4").astype(kind.to_pandas_dtype()))
    if out:
        out.close()
        yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "n_docs": out.n_docs, "n_rows": out.n_rows, "n_tokens": out.n_tokens}], schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_rows", pa.int64()), ("n_tokens", pa.int64())]))


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """Write the files; return their manifest, with `base`, the ids of all files before."""
    folder = qualified(docs.sparkSession, folder) if folder else fresh_path(docs.sparkSession, "token-files")
    write = partial(_write, folder=folder, path=tokenizer or default_path(), length=length)
    dealt = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stage(dealt.mapInArrow(write, FILE_SCHEMA), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, base in rows_of(batch, "file", "base"):
            source, out = TokenFile(name), []
            for doc_id, start, n in source.documents():
                ids = source.tokens(start, n)
                out.append((doc_id, base + start, n, zlib.crc32(ids.astype("<u4"))))
                if len(out) == 10_000:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_OUT)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_OUT)
            source.close()


def read_documents(manifest: DataFrame) -> DataFrame:
    """Each document's place and checksum, from the files, a task for a few files."""
    spark = manifest.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "base").repartition(tasks).mapInArrow(_read, DOC_SCHEMA)
