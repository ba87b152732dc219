"""A store: a folder of sorted Parquet files and log segments under a published manifest.

Writes get consecutive sequence numbers and become a log segment; the manifest's rename
makes them visible at once or not at all. flush() turns segments into level-0 files sorted
by (key, seq desc), with Parquet's Bloom filter on key. Compaction rewrites overlapping
files a level down without versions that no snapshot needs. Both write ranges of keys, a
file each, as many as the bytes ask for, in as many tasks. A deletion is dropped only where
no data outside the compaction, at any level, can hold an older version of its key.

Replaced data is retired, not deleted: views taken before still read it. vacuum() deletes
what was retired longer ago than Options.retention. One writer at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import sizing
from tidemark.operators import levels, scan, versions
from tidemark.operators.blocks import entry_bytes
from tidemark.plans.manifest import File, Folder, Manifest, load
from tidemark.plans.options import BatchCommitted, Conflict, Options, ReadOnly, StoreClosed, StoreError

OPS = "key binary, seq long, kind int, value binary"
FILES = "level int, file_number long, size long, smallest binary, largest binary"


class Batch:
    """An ordered list of operations, written once; adding after that does nothing."""

    def __init__(self):
        self.ops: list[tuple[int, bytes, int, bytes | None]] = []
        self.committed = False

    def put(self, key: bytes, value: bytes | None) -> None:
        if not self.committed:
            self.ops.append((len(self.ops), bytes(key), 1, bytes(value or b"")))

    def delete(self, key: bytes) -> None:
        if not self.committed:
            self.ops.append((len(self.ops), bytes(key), 0, None))

    def clear(self) -> None:
        self.ops, self.committed = [], False

    def size(self) -> int:
        return len(self.ops)


class Store:
    def __init__(self, spark: SparkSession, folder: Folder, manifest: Manifest, options: Options):
        self.spark, self.folder, self.manifest, self.options = spark, folder, manifest, options
        self.closed = False
        #: Calls on this handle: reads, keys written, files that a point read's range check spared or let through.
        self.counters = {"reads": 0, "writes": 0, "files_skipped": 0, "files_opened": 0}

    @classmethod
    def open(cls, spark: SparkSession, root: str, options: Options | None = None) -> Store:
        options = options or Options()
        folder = Folder(spark, root)
        found = load(folder)
        if found and options.error_if_exists:
            raise StoreError(f"{root} exists")
        if not found:
            if not options.create_if_missing or options.read_only:
                raise StoreError(f"{root} doesn't exist")
            if folder.exists() and not folder.fs.getFileStatus(folder.path("")).isDirectory():
                raise StoreError(f"{root} is not a folder")
            folder.make("manifest")
        store = cls(spark, folder, found or Manifest(), options)
        if not found:
            store._publish()
        return store

    def close(self) -> None:
        """Further calls fail. Data retired long enough ago is deleted."""
        if not (self.closed or self.options.read_only):
            self._sweep(self.options.retention)
        self.closed = True

    def _live(self) -> Manifest:
        if self.closed:
            raise StoreClosed("the store is closed")
        return self.manifest

    def _writable(self) -> Manifest:
        if self.options.read_only:
            raise ReadOnly("the store was opened read-only")
        return self._live()

    def _publish(self, **changes) -> None:
        held = asdict(self.manifest) | {"version": self.manifest.version + 1} | changes
        new = Manifest(**held | {"files": [f if isinstance(f, File) else File(**f) for f in held["files"]]})
        self.folder.publish(f"manifest/{new.version:08d}.json", new.to_json())
        self.manifest = new

    # writes

    def put(self, key: bytes, value: bytes | None) -> int:
        batch = Batch()
        batch.put(key, value)
        return self.write(batch)

    def delete(self, key: bytes) -> int:
        batch = Batch()
        batch.delete(key)
        return self.write(batch)

    def write(self, batch: Batch) -> int:
        """Write all of a batch or nothing; the last sequence number."""
        self._writable()
        if batch.committed:
            raise BatchCommitted("the batch is committed already")
        if any(not key for _, key, _, _ in batch.ops):
            raise StoreError("a key can't be empty")
        base = self.manifest.next_seq
        rows = [(key, base + i, kind, value) for i, key, kind, value in batch.ops]
        if rows:
            self._append(self.spark.createDataFrame(rows, OPS), len(rows))
        batch.committed = True
        return self.manifest.next_seq - 1

    def load(self, rows: DataFrame) -> int:
        """Bulk write: rows (op_index, key, kind, value), numbered in the order of op_index."""
        self._writable()
        held = F.when(F.col("kind") == 1, F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
        ops = versions.with_sequence(rows.select("op_index", F.col("key").cast("binary").alias("key"), F.col("kind").cast("int").alias("kind"), held.alias("value")), self.manifest.next_seq)
        checked = F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("a key can't be empty")).cast("binary"))
        self._append(ops.select(checked.alias("key"), F.col("seq").cast("long").alias("seq"), "kind", "value"), None)
        return self.manifest.next_seq - 1

    def _append(self, ops: DataFrame, count: int | None) -> None:
        m = self._writable()
        path = f"log/{m.next_seq:020d}-{uuid.uuid4().hex}"
        ops.write.parquet(f"{self.folder.root}/{path}")
        if count is None:
            count = self.spark.read.schema(OPS).parquet(f"{self.folder.root}/{path}").count()
        size = self.spark.read.schema(OPS).parquet(f"{self.folder.root}/{path}").agg(F.coalesce(F.sum(entry_bytes(F.col("key"), F.col("value"))), F.lit(0))).first()[0]
        try:
            self._publish(next_seq=m.next_seq + count, logs=[*m.logs, {"path": path, "count": count, "bytes": size}])
        except Conflict:
            self.folder.delete(path)
            raise
        self.counters["writes"] += count
        if sum(x["bytes"] for x in self.manifest.logs) >= self.options.write_buffer:
            self.flush()

    # reads

    def _read(self, paths: Iterable[str]) -> DataFrame:
        full = [f"{self.folder.root}/{p}" for p in paths]
        return self.spark.read.schema(OPS).parquet(*full) if full else self.spark.createDataFrame([], OPS)

    def ops(self) -> DataFrame:
        """Every version in every layer."""
        m = self._live()
        return self._read([*(x["path"] for x in m.logs), *(f.path for f in m.files)])

    def view(self, snapshot: int | None = None) -> DataFrame:
        """(key, value, seq): each visible key once."""
        self.counters["reads"] += 1
        return versions.latest(self.ops(), self.manifest.next_seq - 1 if snapshot is None else snapshot)

    def get(self, key: bytes, snapshot: int | None = None) -> bytes | None:
        """The value, or None. Files that can't hold the key aren't opened."""
        m = self._live()
        files = [f.path for f in m.files if f.smallest is None or f.smallest <= key.hex() <= f.largest]
        self.counters["reads"] += 1
        self.counters["files_opened"] += len(files)
        self.counters["files_skipped"] += len(m.files) - len(files)
        ops = self._read([*(x["path"] for x in m.logs), *files])
        row = versions.get(ops, F.lit(bytes(key)), m.next_seq - 1 if snapshot is None else snapshot).first()
        return bytes(row["value"]) if row else None

    def multi_get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        self.counters["reads"] += 1
        return versions.multi_get(self.ops(), keys, self.manifest.next_seq - 1 if snapshot is None else snapshot)

    def range(self, start: bytes | None = None, end: bytes | None = None, snapshot: int | None = None) -> DataFrame:
        lit = lambda k: None if k is None else F.lit(bytes(k))
        return scan.range_scan(self.view(snapshot), lit(start), lit(end)).orderBy("key")

    # snapshots

    def snapshot(self) -> int:
        m = self._live()
        seq = m.next_seq - 1
        self._publish(snapshots=m.snapshots | {str(seq): m.snapshots.get(str(seq), 0) + 1})
        return seq

    def release(self, seq: int) -> None:
        m = self._live()
        left = m.snapshots.get(str(seq), 0) - 1
        rest = {k: v for k, v in m.snapshots.items() if k != str(seq)}
        self._publish(snapshots=rest | ({str(seq): left} if left > 0 else {}))

    def oldest_snapshot(self) -> int:
        return min((int(s) for s in self._live().snapshots), default=0)

    def _needed(self) -> list[int]:
        return sorted(int(s) for s in self.manifest.snapshots)

    # files

    def _write_files(self, ops: DataFrame, level: int) -> list[File]:
        """Sorted files for ranges of the keys, about file_bytes of entries in each. ops is written
        first and counted: what a garbage collection leaves can be far less than it read."""
        work = f"data/work-{uuid.uuid4().hex}"
        try:
            ops.select("key", "seq", "kind", "value").write.parquet(f"{self.folder.root}/{work}")
            left = self._read([work])
            entries, size = left.agg(F.count("*"), F.sum(entry_bytes(F.col("key"), F.col("value")))).first()
            return self._dealt_out(left, level, size, entries) if entries else []
        finally:
            self.folder.delete(work)

    def _dealt_out(self, ops: DataFrame, level: int, size: int, entries: int) -> list[File]:
        """The files of ops, which has so many bytes and entries. The entries size the filters:
        Parquet's own choice is a MB each, whatever they hold."""
        o, first = self.options, self.manifest.next_file
        per_file = max(1, o.partitions)
        n = max(1, -(-size // max(1, o.file_bytes))) * per_file
        folder = f"data/L{level}/files_{first:06d}-{uuid.uuid4().hex}"
        spread = ops.repartitionByRange(n, "key") if n > 1 else ops.coalesce(1)
        number = F.floor(F.spark_partition_id() / per_file).cast("long") + first
        writer = spread.select("key", "seq", "kind", "value", number.alias("file")).sortWithinPartitions("file", "key", F.desc("seq")).write.partitionBy("file")
        if o.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(o.bloom_error))
            writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(max(1, 2 * entries // n)))  # twice the mean: ranges come from a sample
        writer.parquet(f"{self.folder.root}/{folder}")
        held = self.spark.read.schema(f"{OPS}, file long").parquet(f"{self.folder.root}/{folder}").groupBy("file", F.col("_metadata.file_path"), F.col("_metadata.file_size").alias("size"))
        parts = held.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
        rows = parts.groupBy("file").agg(F.hex(F.min("low")).alias("low"), F.hex(F.max("high")).alias("high"), F.sum("n").alias("n"), F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"), F.sum("size").alias("size")).orderBy("file")
        return [File(level, r.file, f"{folder}/file={r.file}", r.size, r.n, r.low.lower(), r.high.lower(), r.max_seq, r.min_seq) for r in rows.collect()]

    def _replace(self, old_files: list[File], old_logs: list[dict], new: list[File], what: str, level: int) -> None:
        """Publish new for old; the old ones' data is retired."""
        m, now = self.manifest, time.time()
        gone = {f.file_number for f in old_files}
        files = [f for f in m.files if f.file_number not in gone] + new
        entry = {"what": what, "at": now, "read": len(old_files) + len(old_logs), "level": level if new else None, "entries": sum(f.entries for f in new)}
        left = [{"path": p, "at": now} for p in [*(f.path for f in old_files), *(x["path"] for x in old_logs)]]
        following = max([m.next_file, *(f.file_number for f in new)]) + 1
        self._publish(files=files, logs=[x for x in m.logs if x not in old_logs], next_file=following, history=[*m.history, entry], retired=[*m.retired, *left])

    def vacuum(self, retention: float | None = None) -> int:
        """Delete data retired at least so many seconds ago; how many files and segments."""
        self._writable()
        return self._sweep(self.options.retention if retention is None else retention)

    def _sweep(self, retention: float) -> int:
        until = time.time() - retention
        old = [x for x in self.manifest.retired if x["at"] <= until]
        if old:
            self._publish(retired=[x for x in self.manifest.retired if x["at"] > until])
            for x in old:
                self.folder.delete(x["path"])
        return len(old)

    def flush(self) -> File | None:
        """Log segments -> level-0 files; the first of them."""
        m = self._writable()
        if not m.logs:
            return None
        ops = versions.collect_garbage(self._read(x["path"] for x in m.logs), self._needed())
        new = self._write_files(ops, 0)
        self._replace([], list(m.logs), new, "flush", 0)
        return new[0] if new else None

    def files(self) -> DataFrame:
        rows = [(f.level, f.file_number, f.size, bytes.fromhex(f.smallest) if f.smallest else None, bytes.fromhex(f.largest) if f.largest else None) for f in self._live().files]
        return self.spark.createDataFrame(rows, FILES)

    @staticmethod
    def _meets(f: File, low: str | None, high: str | None) -> bool:
        return (f.smallest is None or high is None or f.smallest <= high) and (f.largest is None or low is None or f.largest >= low)

    @staticmethod
    def _span(files: Iterable[File]) -> tuple[str | None, str | None]:
        """The least range that holds the files' ranges; a null bound is open."""
        files = list(files)
        ends = lambda xs: None if None in xs else xs
        low, high = ends([f.smallest for f in files]), ends([f.largest for f in files])
        return (min(low) if low else None), (max(high) if high else None)

    def _widened(self, chosen: list[File], level: int) -> list[File]:
        """chosen, and the files of the level that meet their range, until none is left out."""
        taken = {f.file_number: f for f in chosen}
        while True:
            span = self._span(taken.values())
            more = {f.file_number: f for f in self.manifest.files if f.level == level and f.file_number not in taken and self._meets(f, *span)}
            if not more:
                return list(taken.values())
            taken |= more

    def _older_elsewhere(self, taken: list[File]) -> bool:
        """Can a file left out, of any level, or a log segment hold an older version of a taken key?"""
        own, span, newest = {f.file_number for f in taken}, self._span(taken), max(f.max_seq for f in taken)
        files = any(f.file_number not in own and f.min_seq < newest and self._meets(f, *span) for f in self.manifest.files)
        return files or any(int(x["path"].split("/")[1].split("-")[0]) < newest for x in self.manifest.logs)

    def _compact(self, chosen: list[File], target: int, what: str) -> File | None:
        """Merge chosen files, and what they meet at the target level, into files there."""
        if not chosen:
            return None
        if chosen[0].level == 0:  # level-0 files overlap: those that meet go together
            chosen = self._widened(chosen, 0)
        taken = self._widened(chosen, target)
        ops = versions.collect_garbage(self._read(f.path for f in taken), self._needed(), bottom=not self._older_elsewhere(taken))
        new = self._write_files(ops, target)
        self._replace(taken, [], new, what, target)
        return new[0] if new else None

    def compact_range(self, level: int, start: bytes | None = None, end: bytes | None = None) -> File | None:
        """Files of the level that meet the closed range go a level down, at the last in place;
        the first file that comes of it."""
        self._writable()
        if not 0 <= level < self.options.max_levels:
            raise StoreError(f"there is no level {level}")
        low, high = start.hex() if start is not None else None, end.hex() if end is not None else None
        chosen = [f for f in self.manifest.files if f.level == level and self._meets(f, low, high)]
        return self._compact(chosen, min(level + 1, self.options.max_levels - 1), "range")

    def force_compact(self) -> None:
        """Everything, deepest level first."""
        self._writable()
        self.flush()
        for level in reversed(range(self.options.max_levels)):
            self._compact([f for f in self.manifest.files if f.level == level], min(level + 1, self.options.max_levels - 1), "full")

    def maintain(self) -> int:
        """Flush, then compact levels until none needs it; the number of compactions."""
        self._writable()
        self.flush()
        done = 0
        for level in range(self.options.max_levels - 1):
            own = [f for f in self.manifest.files if f.level == level]
            target = self.options.write_buffer * (4 if level == 0 else self.options.level_multiplier**level)
            if len(own) >= self.options.l0_trigger if level == 0 else sum(f.size for f in own) > target:
                self._compact(own, level + 1, "level")
                done += 1
        self._sweep(self.options.retention)
        return done

    # statistics

    def stats(self) -> DataFrame:
        """(level, file_count, total_size, target_size, needs_compaction)."""
        o = self.options
        return levels.level_stats(self.files(), n=o.max_levels, write_buffer=o.write_buffer, trigger=o.l0_trigger, multiplier=o.level_multiplier)

    def bloom_stats(self) -> dict:
        """Of the files' filters: how many, keys, bytes, and the mean chance of a false "maybe"."""
        held = [f for f in self._live().files if self.options.bloom]
        rows = self.spark.createDataFrame([(f.file_number, f.entries) for f in held], "file_number long, n long")
        p = F.lit(self.options.bloom_error)
        sized = rows.withColumn("m", sizing.bloom_bits(F.col("n"), p)).withColumn("k", sizing.bloom_hashes(F.col("n"), F.col("m")))
        error = sizing.bloom_error(F.col("n"), F.col("m"), F.col("k"))
        sums = sized.agg(F.count("*").alias("filters"), F.coalesce(F.sum("n"), F.lit(0)).alias("keys"), F.coalesce(F.sum(sizing.bloom_memory(F.col("m"))), F.lit(0)).alias("bytes"), F.coalesce(F.avg(error), F.lit(0.0)).alias("error")).first()
        return sums.asDict()

    def summary(self) -> dict:
        """Counts of the store, and of this handle's calls (reads, writes, files skipped and opened)."""
        m = self._live()
        return {
            "memtable_size": sum(x["bytes"] for x in m.logs), "log_segments": len(m.logs), "sst_files_total": len(m.files), "total_size": sum(f.size for f in m.files),
            "last_sequence": m.next_seq - 1, "snapshots": len(m.snapshots), "compactions": sum(h["what"] != "flush" for h in m.history), "flushes": sum(h["what"] == "flush" for h in m.history),
            "last_compaction": max((h["at"] for h in m.history if h["what"] != "flush"), default=None), "retired": len(m.retired), **self.counters, **{f"bloom_{k}": v for k, v in self.bloom_stats().items()},
        }

    def history(self) -> DataFrame:
        schema = "what string, at double, read long, level int, entries long"
        rows = [(h["what"], h["at"], h["read"], h["level"], h["entries"]) for h in self._live().history]
        return self.spark.createDataFrame(rows, schema)

