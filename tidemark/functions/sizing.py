"""Formulas: Bloom filter sizes and error, level targets, compaction priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults.
WRITE_BUFFER = 4 << 20
LEVEL_MULTIPLIER = 10
MAX_LEVELS = 7
L0_TRIGGER = 4
FALSE_POSITIVES = 0.01


def bloom_bits(n: Column, p: Column) -> Column:
    """ceil(-n ln p / ln(2)^2); 1024 where n or p can't be used."""
    usable = (n > 0) & (p > 0) & (p < 1)
    safe_p = F.when(usable, p).otherwise(F.lit(0.5))
    return F.when(usable, F.ceil(-n * F.log(safe_p) / F.pow(F.log(F.lit(2.0)), F.lit(2.0)))).otherwise(1024).cast("long")


def bloom_hashes(n: Column, m: Column) -> Column:
    """ceil(m / n ln 2); 4 where n or m can't be used."""
    usable = (n > 0) & (m > 0)
    return F.when(usable, F.ceil(m / F.when(usable, n) * F.log(F.lit(2.0)))).otherwise(4).cast("int")


def bloom_error(n: Column, m: Column, k: Column) -> Column:
    """(1 - e^(-kn/m))^k; 0 for an empty filter."""
    return F.when(n > 0, F.pow(1 - F.exp(-k * n / m), k)).otherwise(0.0)


def bloom_capacity(m: Column) -> Column:
    """Keys for which m bits give one percent of false positives."""
    per_key = -F.log(F.lit(0.01)) / F.pow(F.log(F.lit(2.0)), F.lit(2.0))
    return F.floor(m / per_key).cast("long")


def bloom_memory(m: Column) -> Column:
    return (F.ceil(m / 8) + 20).cast("long")


def level_target(level: Column, write_buffer: int = WRITE_BUFFER, multiplier: int = LEVEL_MULTIPLIER) -> Column:
    """Bytes: four buffers at level 0, else buffer * multiplier^level."""
    m = float(multiplier if multiplier > 0 else LEVEL_MULTIPLIER)
    deeper = F.lit(float(write_buffer)) * F.pow(F.lit(m), level)
    return F.when(level == 0, F.lit(4.0 * write_buffer)).otherwise(deeper).cast("long")


def compaction_priority(level: Column, n_files: Column, size: Column, target: Column, hours: Column, trigger: int = L0_TRIGGER, multiplier: int = LEVEL_MULTIPLIER) -> Column:
    """At most 1: four tenths by files, four by size, two by hours since the last one."""
    files = 0.4 * n_files / (F.lit(trigger) * F.pow(F.lit(float(multiplier)), level).cast("long"))
    return F.least(F.lit(1.0), files + 0.4 * size / target + 0.2 * F.least(F.lit(1.0), hours / 24.0))


def compaction_mode(priority: Column) -> Column:
    return F.when(priority > 0.7, "aggressive").when(priority > 0.3, "standard").otherwise("lazy")
