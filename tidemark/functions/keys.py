"""Keys and log records as column expressions.

A key is BINARY and ordered as unsigned bytes, shorter prefix first, which is Spark's own
order. Internal keys, key || big-endian (seq << 8 | kind), exist for exchange only: versions
are sorted by the columns (key, seq), since concatenated keys of different lengths interleave.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETE, PUT = 0, 1


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed_hex(value: Column, width: int) -> Column:
    """value as `width` hex digits, high ones first."""
    return F.lower(F.lpad(F.hex(value), width, "0"))


def packed_suffix(seq: Column | str, kind: Column | str) -> Column:
    """seq << 8 | kind as 16 hex digits."""
    return fixed_hex(F.shiftleft(_column(seq), 8).bitwiseOR(_column(kind).cast("long")), 16)


def encode_internal_key(key: Column | str, seq: Column | str, kind: Column | str) -> Column:
    return F.concat(_column(key), F.unhex(packed_suffix(seq, kind)))


def decode_internal_key(internal: Column | str) -> Column:
    """struct(key, seq, kind); under 8 bytes: (null, 0, 0)."""
    c = _column(internal)
    size = F.length(c)
    last = F.conv(F.hex(F.substring(c, -8, 8)), 16, 10).cast("decimal(20,0)")
    seq = F.floor(last / 256).cast("long")
    kind = F.conv(F.hex(F.substring(c, -1, 1)), 16, 10).cast("int")
    short = size < 8
    return F.struct(
        F.when(short, F.lit(None).cast("binary")).otherwise(F.substring(c, F.lit(1), size - 8)).alias("key"),
        F.when(short, F.lit(0).cast("long")).otherwise(seq).alias("seq"),
        F.when(short, F.lit(0)).otherwise(kind).alias("kind"),
    )


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by unsigned bytes."""
    a, b = _column(a), _column(b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def equal(a: Column | str, b: Column | str) -> Column:
    """Null equals null and nothing else."""
    return _column(a).eqNullSafe(_column(b))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Characters (bytes, for BINARY) that both begin with."""
    a, b = _column(a), _column(b)
    shorter = F.least(F.length(a), F.length(b)).cast("long")
    places = F.when(shorter > 0, F.sequence(F.lit(1).cast("long"), shorter)).otherwise(F.array().cast("array<long>"))
    differ = F.array_min(F.filter(places, lambda i: F.substring(a, i.cast("int"), F.lit(1)) != F.substring(b, i.cast("int"), F.lit(1))))
    return F.coalesce(differ - 1, shorter)


def safe_string(key: Column | str) -> Column:
    return F.coalesce(_column(key).cast("string"), F.lit("<nil>"))


def _little_endian(value: Column, size: int) -> Column:
    digits = fixed_hex(value, 2 * size)
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size)))))


def encode_log_record(seq: Column | str, kind: Column | str, key: Column | str, value: Column | str) -> Column:
    """Little-endian seq8 kind1 keylen4 key valuelen4 value crc4; a delete has no value.

    The sum is CRC-32 (IEEE) of all bytes before it.
    """
    seq, kind, key, value = map(_column, (seq, kind, key, value))
    held = F.when(kind == PUT, F.coalesce(value, F.lit(b""))).otherwise(F.lit(b""))
    body = F.concat(_little_endian(seq, 8), _little_endian(kind.cast("long"), 1), _little_endian(F.length(key).cast("long"), 4), key, _little_endian(F.length(held).cast("long"), 4), held)
    return F.concat(body, _little_endian(F.crc32(body), 4))
