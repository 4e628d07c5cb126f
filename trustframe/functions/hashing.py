"""Deterministic randomness.

All draws come from md5 over ``seed | key ...``, so a result does not depend on
partitioning, task retries or the engine that computes it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_md5(*parts: Column | str | int) -> Column:
    """Hex md5 of the parts; plain Python values are taken as literals."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_int(*parts: Column | str | int) -> Column:
    """Uniform integer in [0, 2**60)."""
    return F.conv(F.substring(key_md5(*parts), 1, 15), 16, 10).cast("bigint")


def hash_unit(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(*parts) / F.lit(float(1 << 60))


def hash_below(n: Column | int, *parts: Column | str | int) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(hash_int(*parts), n if isinstance(n, Column) else F.lit(n))
