"""Deterministic, engine-independent randomness.

A uniform number is derived from ``md5(seed ':' key)``: the first 8 hex digits
read as an unsigned integer divided by 2^32.  It depends only on the row key,
so it is identical on every retry of a task (executor loss is harmless), on
any partitioning, and in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def seeded_hash(seed, *keys) -> Column:
    """md5 hex digest of ``seed:key1:key2...`` (keys are columns or names)."""
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit(":"), (F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.md5(F.concat(*parts))


def uniform01(seed, *keys) -> Column:
    """U[0, 1) from the key columns and the seed."""
    h = seeded_hash(seed, *keys)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(_TWO_32)


def uniform52(seed, *keys) -> Column:
    """U[0, 1) of 52 bits, for draws among more than 2^32 things."""
    h = seeded_hash(seed, *keys)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
