"""Portable deterministic hashes (same values in Spark SQL and any SQL engine with MD5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 1 << 32


def seeded_hash(key: Column | str, seed: Column | int = 0) -> Column:
    """First 32 bits of MD5 of ``seed:key`` as a long: seeds give unrelated orders of the keys."""
    k = F.col(key) if isinstance(key, str) else key
    s = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws(":", s.cast("string"), k.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
