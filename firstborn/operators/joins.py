"""Joining per-group tables back to rows when a few groups hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1 << 20


def skew_join(
    rows: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    size: str,
    spread: str | Sequence[str],
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join ``rows`` to ``groups``, splitting the groups that hold many rows.

    ``size`` is the number (or a bound) of ``rows`` in the group, the same on every
    ``groups`` row of one key.  Only groups above ``rows_per_salt``
    rows are salted: there are at most ``n / rows_per_salt`` of them, which
    bounds the broadcast list of hot keys.  Their group rows are repeated once
    per salt; all other groups keep salt 0 and are joined once.
    """
    on = list(on)
    salts = F.ceil(F.col(size) / F.lit(rows_per_salt)).cast("int")
    hot = groups.filter(F.col(size) > rows_per_salt).select(*on, salts.alias("_salts")).distinct()
    salted_rows = (
        rows.join(F.broadcast(hot), on, "left")
        .withColumn(
            "_salt",
            F.coalesce(F.pmod(F.xxhash64(*([spread] if isinstance(spread, str) else spread)), F.col("_salts")), F.lit(0)).cast("int"),
        )
        .drop("_salts")
    )
    salted_groups = groups.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))
    )
    return salted_rows.join(salted_groups, [*on, "_salt"], how).drop("_salt")
