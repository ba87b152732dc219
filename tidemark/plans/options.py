"""Settings of a store; the defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.functions import sizing


class StoreError(Exception):
    """Any failure of a store."""


class StoreClosed(StoreError):
    pass


class ReadOnly(StoreError):
    pass


class Corrupted(StoreError):
    pass


class Conflict(StoreError):
    """Another writer published first."""


class BatchCommitted(StoreError):
    """A batch was written already; clear() makes it usable again."""


@dataclass(frozen=True)
class Options:
    create_if_missing: bool = True
    error_if_exists: bool = False
    read_only: bool = False
    write_buffer: int = sizing.WRITE_BUFFER
    max_levels: int = sizing.MAX_LEVELS
    l0_trigger: int = sizing.L0_TRIGGER
    level_multiplier: int = sizing.LEVEL_MULTIPLIER
    bloom: bool = True
    bloom_error: float = sizing.FALSE_POSITIVES
    #: Part files of a table file, and bytes after which a flush or compaction starts another one.
    partitions: int = 1
    file_bytes: int = 256 << 20
    #: Seconds that replaced data stays for readers that began before.
    retention: float = 3600.0
