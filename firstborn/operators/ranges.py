"""Range lookups along the birth axis as differences of running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import skew_join
from .labels import cluster_sizes
from .order import running_sums


def clusters_between(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clusters younger than the observation's own and older than the observation.

    No range join: the count (and member total) of births before the
    observation minus those up to its own cluster.
    """
    sizes = running_sums(
        cluster_sizes(assignments, by),
        {"_clusters": F.lit(1).cast("bigint"), "_members": F.col("n_k")},
        "cluster",
        by,
        inclusive=True,
    )
    births = sizes.select(*by, F.col("cluster").alias("obs"), F.col("n_k").alias("_born"))
    points = assignments.select(*by, "obs", "cluster").join(births, [*by, "obs"], "left")
    before = running_sums(
        points,
        {
            "_b_clusters": F.col("_born").isNotNull().cast("bigint"),
            "_b_members": F.coalesce("_born", F.lit(0)),
        },
        "obs",
        by,
    ).drop("_born")
    joined = skew_join(before, sizes, [*by, "cluster"], size="n_k", spread="obs")
    inside = F.col("obs") > F.col("cluster")
    return joined.select(
        *by,
        "obs",
        F.when(inside, F.col("_b_clusters") - F.col("_clusters")).otherwise(0).alias("between_clusters"),
        F.when(inside, F.col("_b_members") - F.col("_members")).otherwise(0).alias("between_members"),
    )
