"""Parameter posteriors on a grid, for every draw at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import hash_uniform
from ..functions.special import lbeta, lgamma
from ..models import StickArrivalPrior
from ..operators.choice import gumbel_choice, key_of
from ..operators.draws import normalised_weights
from ..operators.joins import skew_join
from ..operators.prior import arrival_columns, complement_counts, partition_shape


def _log_point(g: Column, points: int, low: float, n: Column) -> Column:
    """Midpoint ``g`` of ``points`` equal cells of ln x over (low, n)."""
    span = F.ln(n.cast("double")) - F.lit(math.log(low))
    return F.exp(F.lit(math.log(low)) + span * ((g - 0.5) / F.lit(float(points))))


def alpha_grid(sizes: DataFrame, by: Sequence[str], points: int = 64, low: float = 1e-3) -> DataFrame:
    """Normalised posterior of alpha under a flat prior on (0, n).

    Only (n, K) of a draw matters, so the grid is an array exploded on the
    one row per draw.  Cells are equal in ln alpha; the extra ln alpha is the
    cell width.
    """
    shape = partition_shape(sizes, by)
    grid = shape.withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(points)))).withColumn(
        "alpha", _log_point(F.col("g"), points, low, F.col("n"))
    )
    alpha = F.col("alpha")
    score = F.col("k") * F.ln(alpha) + lgamma(alpha) - lgamma(F.col("n") + alpha) + F.ln(alpha)
    return normalised_weights(grid.withColumn("log_weight", score), "log_weight", by, "probability")


def stick_grid(
    sizes: DataFrame, by: Sequence[str], points: int = 8, low: float = 1e-1, levels: int = 2
) -> DataFrame:
    """Normalised posterior of the stick parameters (a, b) on a square log grid.

    Equal (size, complement) pairs are merged before the grid is exploded.
    """
    shape = partition_shape(sizes, by)
    sticks = complement_counts(sizes, by, levels).filter(F.col("cluster") > 1)
    merged = sticks.groupBy(*by, "n_k", "comp").agg(F.count("*").alias("_times"))
    axes = F.explode(F.sequence(F.lit(0), F.lit(points * points - 1)))
    ga, gb = F.floor(F.col("cell") / points).cast("int") + 1, (F.col("cell") % points) + 1
    base = shape.withColumn("cell", axes)
    base = base.withColumns(
        {
            "psi_a": _log_point(ga, points, low, F.col("n")),
            "psi_b": _log_point(gb, points, low, F.col("n")),
        }
    )
    a, b = F.col("psi_a"), F.col("psi_b")
    gain = lbeta(a + F.col("n_k") - 1.0, b + F.col("comp")) - lbeta(a, b)
    scored = (
        skew_join(merged, base, by, size="k", spread=["n_k", "comp"])
        .groupBy(*by, "cell")
        .agg(F.sum(F.col("_times") * gain).alias("_score"))
    )
    # A partition of one cluster has no stick and keeps the prior weight.
    weighted = base.join(scored, [*by, "cell"], "left").withColumn(
        "log_weight", F.coalesce("_score", F.lit(0.0)) + F.ln(a) + F.ln(b)
    ).drop("_score", "n", "k")
    return normalised_weights(weighted, "log_weight", by, "probability")


def arrival_grid(sizes: DataFrame, prior: StickArrivalPrior, by: Sequence[str], points: int = 64) -> DataFrame:
    """Arrival-rate posterior on midpoints of (0, 1), with its exact parameters."""
    shape = partition_shape(sizes, by).withColumns(arrival_columns(prior))
    grid = shape.withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(points)))).withColumn(
        "phi", (F.col("g") - 0.5) / F.lit(float(points))
    )
    phi = F.col("phi")
    score = (F.col("arrival_a") - 1) * F.ln(phi) + (F.col("arrival_b") - 1) * F.ln(1 - phi)
    return grid.withColumn("log_weight", score)


def arrival_moments(sizes: DataFrame, prior: StickArrivalPrior, by: Sequence[str]) -> DataFrame:
    shape = partition_shape(sizes, by).withColumns(arrival_columns(prior))
    a, b = F.col("arrival_a"), F.col("arrival_b")
    total = a + b
    return shape.withColumns(
        {"phi_mean": a / total, "phi_sd": F.sqrt(a * b / (total * total * (total + 1)))}
    )


def grid_draw(grid: DataFrame, by: Sequence[str], point: str, seed: str = "") -> DataFrame:
    """One grid point per group, drawn by the Gumbel-max rule."""
    uniform = hash_uniform(F.concat_ws(":", F.lit(seed), key_of(*by, point)))
    return gumbel_choice(grid, by, point, "log_weight", uniform)
