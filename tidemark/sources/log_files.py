"""Raw log files: a header and a run of checksummed records, both little-endian.

Header, 24 bytes: magic u32 0xDB, version u32 1, created i64, reserved u32, CRC-32 of these
20 bytes. Record: seq u64, kind u8, key length u32, key, value length u32, value, CRC-32 of
all that. A file is read by one task, as a stream; a task holds one record and one batch of
rows. A record cut off at the end of a file is the sign of a crash and ignored, any other
damage raises LogCorrupted.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import encode_log_record
from tidemark.sources.shared import qualified, stage

MAGIC, VERSION, HEADER = 0xDB, 1, 24
#: Bytes of a read, and rows and bytes of a batch of decoded operations.
PIECE, ROWS, BYTES = 1 << 20, 10_000, 8 << 20
SCHEMA = "file string, key binary, seq long, kind int, value binary"
_OPS = pa.schema([("file", pa.string()), ("key", pa.binary()), ("seq", pa.int64()), ("kind", pa.int32()), ("value", pa.binary())])


class LogCorrupted(ValueError):
    """A log file whose header, length or checksum can't be right."""


def header(created: int = 0) -> bytes:
    body = struct.pack("<IIqI", MAGIC, VERSION, created, 0)
    return body + struct.pack("<I", zlib.crc32(body))


def check_header(data: bytes) -> None:
    if len(data) < HEADER:
        raise LogCorrupted("the header is cut off")
    magic, version, _, _, crc = struct.unpack_from("<IIqII", data)
    if magic != MAGIC:
        raise LogCorrupted(f"magic is {magic:#x}")
    if version != VERSION:
        raise LogCorrupted(f"version is {version}")
    if crc != zlib.crc32(data[: HEADER - 4]):
        raise LogCorrupted("the header's checksum is wrong")


def encode_record(seq: int, kind: int, key: bytes, value: bytes | None) -> bytes:
    held = (value or b"") if kind else b""
    body = struct.pack("<QBI", seq, kind, len(key)) + key + struct.pack("<I", len(held)) + held
    return body + struct.pack("<I", zlib.crc32(body))


class _Source:
    """Bytes of a stream in order; take() gives None once fewer are left than asked for."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.at = stream, 0

    def take(self, size: int) -> bytes | None:
        parts, left = [], size
        while left:
            part = self.stream.read(min(left, PIECE))
            if not part:
                return None
            parts.append(part)
            left -= len(part)
        self.at += size
        return parts[0] if len(parts) == 1 else b"".join(parts)


def stream_records(stream: BinaryIO) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(seq, kind, key, value) of a log file's records, one at a time."""
    source = _Source(stream)
    check_header(source.take(HEADER) or b"")
    while True:
        start = source.at
        if (head := source.take(13)) is None:
            return
        seq, kind, size = struct.unpack("<QBI", head)
        if (key := source.take(size)) is None or (sized := source.take(4)) is None:
            return
        if (value := source.take(int.from_bytes(sized, "little"))) is None or (stored := source.take(4)) is None:
            return
        crc = 0
        for part in (head, key, sized, value):
            crc = zlib.crc32(part, crc)
        if crc != int.from_bytes(stored, "little"):
            raise LogCorrupted(f"the record at byte {start} has a wrong checksum")
        if kind not in (0, 1):
            raise LogCorrupted(f"the record at byte {start} is of kind {kind}")
        yield seq, kind, key, value if kind else None


def decode_records(data: bytes) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    return stream_records(io.BytesIO(data))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, place = pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
            rows, size = [], 0
            with fs.open_input_stream(place, buffer_size=PIECE) as stream:
                for seq, kind, key, value in stream_records(stream):
                    rows.append((path, key, seq, kind, value))
                    size += len(key) + len(value or b"")
                    if len(rows) == ROWS or size > BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OPS, strict=True)], schema=_OPS)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The operations of all log files at the path or glob, files of any size, a few a task."""
    names = spark.read.format("binaryFile").load(path).select("path")
    return names.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_decode, SCHEMA)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    part, sink, rows = TaskContext.get().partitionId(), None, 0
    name = f"{folder}/LOG.{part + 1}-{uuid.uuid4().hex}"
    fs, place = pa.fs.FileSystem.from_uri(name)
    for batch in batches:
        if batch.num_rows and sink is None:
            fs.create_dir(place.rpartition("/")[0], recursive=True)
            sink = fs.open_output_stream(place)
            sink.write(header())
        for record in batch.column("record").to_pylist():
            sink.write(record)
            rows += 1
    if sink is not None:
        sink.close()
        yield pa.RecordBatch.from_pylist([{"file": name, "records": rows}])


def write_logs(ops: DataFrame, folder: str) -> DataFrame:
    """Write operations (key binary, seq, kind, value binary) as log files, one a task and in
    order of seq within it; (file, records), a written table. Files of failed attempts aren't in it."""
    spark = ops.sparkSession
    records = ops.select("seq", encode_log_record("seq", "kind", "key", "value").alias("record")).repartitionByRange("seq").sortWithinPartitions("seq")
    return stage(records.select("record").mapInArrow(partial(_write, folder=qualified(spark, folder)), "file string, records long"), "log-files")


def read_named(files: DataFrame) -> DataFrame:
    """The operations of the log files named in files (file)."""
    tasks = files.sparkSession.sparkContext.defaultParallelism
    return files.select(F.col("file").alias("path")).repartition(tasks).mapInArrow(_decode, SCHEMA)
