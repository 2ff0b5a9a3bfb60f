"""Random numbers derived from keys, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash52(key: Column) -> Column:
    """The first 13 hex digits of md5 as an integer in [0, 2^52)."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")


def hash_uniform(key: Column) -> Column:
    """Uniform on (0, 1) from a string key; also computable outside Spark."""
    u = hash52(key) / F.lit(float(2**52))
    return F.when(u == 0, F.lit(2.0**-53)).otherwise(u)


def row_uniform(*parts) -> Column:
    """Uniform on (0, 1) from any key columns: the cheap form the samplers use."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    return (bits.cast("double") + 0.5) * F.lit(2.0**-53)


def gumbel(uniform: Column) -> Column:
    """Standard Gumbel noise from a uniform."""
    return -F.ln(-F.ln(uniform))
