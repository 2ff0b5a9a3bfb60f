"""Categorical draws by the Gumbel-max rule, with noise derived from row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import gumbel, hash_uniform


def key_of(*columns: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def gumbel_choice(
    rows: DataFrame, by: Sequence[str], choice: str, log_weight: str, uniform: Column
) -> DataFrame:
    """One draw per ``by`` group: the argmax of log weight plus Gumbel noise.

    ``max_by`` is a partial aggregate, so a group of any size is combined
    map-side.
    """
    noisy = F.col(log_weight) + gumbel(uniform)
    best = F.max_by(F.struct(choice, log_weight), F.struct(noisy, -F.col(choice)))
    return rows.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col(f"_b.{choice}").alias(choice), F.col(f"_b.{log_weight}").alias(log_weight)
    )


def gumbel_resample(
    rows: DataFrame, by: Sequence[str], choice: str, log_weight: str, num_draws: int, seed: str = ""
) -> DataFrame:
    """``num_draws`` independent draws per group."""
    repeated = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(num_draws))))
    key = F.concat_ws(":", F.lit(seed), key_of(*by, choice, "draw"))
    return gumbel_choice(repeated, [*by, "draw"], choice, log_weight, hash_uniform(key))
