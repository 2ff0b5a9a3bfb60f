"""Cluster labels: canonical ids, contiguous ids, one-hot, births and neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import skew_join
from .order import alive_clusters, running_sums


def canonical_labels(rows: DataFrame, label: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Replace any labelling by the position of each block's first member.

    The minimum is an aggregate, combined before the shuffle, and comes back
    through a join that splits large blocks; a window would sort a whole block
    in one task.
    """
    keys = [*by, *label]
    births = rows.groupBy(*keys).agg(F.min("obs").alias("cluster"), F.count("*").alias("_size"))
    return skew_join(rows, births, keys, size="_size", spread="obs").drop("_size")


def blocks_to_assignments(blocks: DataFrame, by: Sequence[str], members: str = "members") -> DataFrame:
    """A list of blocks to one row per member, labelled by the block's minimum."""
    return blocks.select(
        *by, F.array_min(members).alias("cluster"), F.explode(members).alias("obs")
    ).select(*by, "obs", "cluster")


def cluster_sizes(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return assignments.groupBy(*by, "cluster").agg(F.count("*").alias("n_k"))


def keep_iterations(draws: DataFrame, burn_in: int = 0, skip: int = 1) -> DataFrame:
    """Drop burn-in, then keep absolute iteration numbers divisible by ``skip``; of folded draws, inside the paths."""

    def kept(it):
        return (it > burn_in) & (it % skip == 0)

    if "path" in draws.columns:
        return draws.withColumn("path", F.filter("path", lambda p: kept(p["iteration"])))
    return draws.filter(kept(F.col("iteration")))


def one_hot(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sparse one-hot encoding: only the ones."""
    return assignments.select(*by, "cluster", "obs", F.lit(1).cast("bigint").alias("value"))


def one_hot_dense(assignments: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """One 0/1 column c1, c2, ... per arrival rank, for every cluster of a series.

    ``most`` is the largest number of clusters a series can have; a cluster of a higher rank
    is an error, never a row of zeros.
    """
    ranked = contiguous_labels(assignments, by)
    rank = F.when(F.col("rank") <= most, F.col("rank")).otherwise(
        F.raise_error(F.lit(f"a series has more than {most} clusters")).cast("bigint")
    )
    flags = [(F.col("_rank") == c).cast("bigint").alias(f"c{c}") for c in range(1, most + 1)]
    return ranked.select(*by, "obs", rank.alias("_rank")).select(*by, "obs", *flags)


def cluster_ranks(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Arrival rank 1..K of every cluster, a running count along the birth axis."""
    return running_sums(sizes, {"rank": F.lit(1).cast("bigint")}, "cluster", by, inclusive=True)


def contiguous_labels(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ranks = cluster_ranks(cluster_sizes(assignments, by), by)
    return skew_join(assignments, ranks, [*by, "cluster"], size="n_k", spread="obs").drop("n_k")


def arrivals(assignments: DataFrame) -> DataFrame:
    return assignments.withColumn("is_arrival", F.col("obs") == F.col("cluster"))


def with_sizes(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sizes = cluster_sizes(assignments, by)
    return skew_join(assignments, sizes, [*by, "cluster"], size="n_k", spread="obs")


def eligible_to_move(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Members after the birth, and births that stand alone."""
    sized = with_sizes(assignments, by)
    return sized.filter((F.col("obs") > F.col("cluster")) | (F.col("n_k") == 1))


def births_after_removal(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each cluster's next birth position if its first member left (null if it would be empty)."""
    later = F.when(F.col("obs") > F.col("cluster"), F.col("obs"))
    return assignments.groupBy(*by, "cluster").agg(
        F.count("*").alias("n_k"), F.min(later).alias("next_birth")
    )


def move_observations(assignments: DataFrame, moves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Apply ``moves(obs, new_cluster)`` and recompute births.

    A cluster that lost its first member takes the next one; a cluster joined
    by an earlier observation takes that one.
    """
    target = moves.select(*by, "obs", F.col("new_cluster").alias("_to"))
    moved = assignments.join(target, [*by, "obs"], "left")
    # A newly opened cluster carries the mover's position, which may also be
    # the label of the block it left; the flag keeps the two apart.
    opened = F.coalesce(F.col("_to") == F.col("obs"), F.lit(False))
    raw = moved.withColumns(
        {"_label": F.coalesce("_to", "cluster"), "_opened": opened}
    ).drop("cluster", "_to")
    return canonical_labels(raw, ["_label", "_opened"], by).drop("_label", "_opened")


def neighbour_candidates(assignments: DataFrame, radius: int, by: Sequence[str] = ()) -> DataFrame:
    """Clusters older than the observation within ``radius`` ranks of its own, plus itself.

    Ranks make the neighbourhood an equi-join on at most ``2 radius + 1`` keys
    per observation instead of a comparison with every cluster.
    """
    sizes = cluster_sizes(assignments, by)
    ranks = cluster_ranks(sizes, by)
    alive = alive_clusters(assignments, by)
    own = skew_join(alive, ranks, [*by, "cluster"], size="n_k", spread="obs")
    low = F.greatest(F.lit(1).cast("bigint"), F.col("rank") - radius)
    high = F.least(F.col("alive_before"), F.col("rank") + radius)
    slots = own.select(
        *by,
        "obs",
        "cluster",
        F.explode(
            F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        ).alias("rank"),
    )
    births = ranks.select(*by, "rank", F.col("cluster").alias("candidate"))
    older = slots.join(births, [*by, "rank"]).select(*by, "obs", "cluster", "candidate")
    itself = assignments.select(*by, "obs", "cluster", F.col("obs").alias("candidate"))
    return older.unionByName(itself)
