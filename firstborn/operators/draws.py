"""Summaries of posterior draws: weights, histograms, frequencies and arrivals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_reliably
from .joins import skew_join

DRAW = ("chain", "iteration")


def is_folded(draws: DataFrame) -> bool:
    """Whether ``draws`` has one row per observation, with ``path`` (iteration, cluster) in order of iteration."""
    return "path" in draws.columns


def unfold(draws: DataFrame) -> DataFrame:
    """One row per observation and draw."""
    rest = [c for c in draws.columns if c != "path"]
    return draws.select(*rest, F.explode("path").alias("_p")).select(*rest, "_p.iteration", "_p.cluster")


def clusters_per_draw(draws: DataFrame, by: Sequence[str] = DRAW) -> DataFrame:
    """Number of clusters, from births: each cluster has exactly one member at its own position."""
    births = (F.col("obs") == F.col("cluster")).cast("bigint")
    return draws.groupBy(*by).agg(F.sum(births).alias("num_clusters"))


def mean_clusters(counts: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    if weight is None:
        return counts.groupBy(*by).agg(F.avg("num_clusters").alias("mean_clusters"))
    value = F.sum(F.col(weight) * F.col("num_clusters")) / F.sum(weight)
    return counts.groupBy(*by).agg(value.alias("mean_clusters"))


def fixed_histogram(rows: DataFrame, value: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins (edge_i, edge_i+1]; empty bins are returned, values outside are not counted."""
    below: Column = F.lit(0)
    for e in edges:
        below = below + F.when(F.col(value) > F.lit(e), 1).otherwise(0)
    inside = rows.withColumn("bin", below).filter((F.col("bin") >= 1) & (F.col("bin") < len(edges)))
    counts = inside.groupBy(*by, "bin").agg(F.count("*").alias("cnt"))
    bins = F.explode(
        F.array(
            *[
                F.struct(F.lit(i + 1).alias("bin"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"))
                for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
            ]
        )
    ).alias("b")
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    grid = groups.select(*by, bins).select(*by, "b.bin", "b.low", "b.high")
    return grid.join(counts, [*by, "bin"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("bigint")))


def equal_width_histogram(rows: DataFrame, value: str, bins: int, by: Sequence[str]) -> DataFrame:
    """``bins`` equal cells over each group's own range, the top cell closed."""
    span = rows.groupBy(*by).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_rows")
    )
    spread = [c for c in rows.columns if c not in by]
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    cell = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.lit(bins), (F.floor((F.col(value) - F.col("_lo")) / width) + 1).cast("int"))
    )
    placed = skew_join(rows, span, by, size="_rows", spread=spread)
    return placed.groupBy(*by, cell.alias("bin")).agg(F.count("*").alias("cnt"))


def _tops(rows: DataFrame, log_weight: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.max(log_weight).alias("_top"), F.count("*").alias("_rows"))


def normalised_weights(
    rows: DataFrame, log_weight: str, by: Sequence[str], name: str = "weight", count: str | None = None
) -> DataFrame:
    """Softmax within each group, shifted by its maximum.

    Maximum and sum are aggregates joined back, with large groups split: a
    window would hold a whole group in one task.  The rows are read several times,
    so they are written once: what computes them runs once.  ``count`` names a column for the
    rows of the group.
    """
    rows = persist_reliably(rows)
    spread = [c for c in rows.columns if c not in by]
    top = _tops(rows, log_weight, by)
    weight = F.exp(F.col(log_weight) - F.col("_top"))
    mass = (
        skew_join(rows, top, by, size="_rows", spread=spread)
        .groupBy(*by, "_top", "_rows")
        .agg(F.sum(weight).alias("_mass"))
    )
    joined = skew_join(rows, mass, by, size="_rows", spread=spread)
    joined = joined.withColumn(name, weight / F.col("_mass"))
    if count is not None:
        joined = joined.withColumn(count, F.col("_rows"))
    return joined.drop("_top", "_mass", "_rows")


def effective_size(rows: DataFrame, log_weight: str, by: Sequence[str]) -> DataFrame:
    rows = persist_reliably(rows)
    spread = [c for c in rows.columns if c not in by]
    w = F.exp(F.col(log_weight) - F.col("_top"))
    joined = skew_join(rows, _tops(rows, log_weight, by), by, size="_rows", spread=spread)
    return joined.groupBy(*by).agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))


def signatures(draws: DataFrame, by: Sequence[str] = DRAW) -> DataFrame:
    """An order-free 128-bit fingerprint of each draw's canonical labels.

    Two exclusive-or folds of row hashes combine map-side, so no draw is ever
    gathered into one list.
    """
    one = F.bit_xor(F.xxhash64("obs", "cluster"))
    two = F.bit_xor(F.xxhash64(F.lit("second"), "cluster", "obs"))
    return draws.groupBy(*by).agg(one.alias("sig_a"), two.alias("sig_b"))


def clustering_frequencies(sigs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct sampled clusterings with their share of the draws and first iteration."""
    total = sigs.groupBy(*by).agg(F.count("*").alias("num_draws"))
    freq = sigs.groupBy(*by, "sig_a", "sig_b").agg(
        F.count("*").alias("times"), F.min("iteration").alias("first_iteration")
    )
    return freq.join(total, list(by)).withColumn("frequency", F.col("times") / F.col("num_draws"))


def batch_standard_errors(sigs: DataFrame, targets: DataFrame, by: Sequence[str], draws_per_chain: int) -> DataFrame:
    """Batch-means standard error of each target clustering's frequency.

    Iterations must run 1..T.  At most ceil(sqrt T) batches of floor(sqrt T) draws
    or one more, so that every draw is in one.  Only hits are joined: a batch without
    a hit contributes 0 to the sums.
    """
    least = math.isqrt(draws_per_chain)
    batches = min(math.ceil(math.sqrt(draws_per_chain)), draws_per_chain // least)
    length = draws_per_chain / batches
    keys = [*by, "sig_a", "sig_b"]
    batch = F.floor((F.col("iteration") - 1) * batches / F.lit(draws_per_chain))
    held = F.ceil((F.col("_batch") + 1) * draws_per_chain / F.lit(batches)) - F.ceil(
        F.col("_batch") * draws_per_chain / F.lit(batches)
    )
    hits = (
        sigs.withColumn("_batch", batch)
        .groupBy(*keys, "_batch")
        .agg((F.count("*") / held).alias("_p"))
        .groupBy(*keys)
        .agg(F.sum("_p").alias("_s1"), F.sum(F.col("_p") * F.col("_p")).alias("_s2"))
    )
    out = targets.join(hits, keys, "left").fillna(0.0, ["_s1", "_s2"])
    if batches < 2:
        return out.withColumn("se", F.lit(None).cast("double")).drop("_s1", "_s2")
    spread = F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / batches, F.lit(0.0))
    se = F.sqrt(F.lit(length / (batches - 1)) * spread) / F.sqrt(F.lit(float(draws_per_chain)))
    return out.withColumn("se", se).drop("_s1", "_s2")


def arrival_probabilities(draws: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    hit = (F.col("obs") == F.col("cluster")).cast("double")
    return draws.groupBy(*by, "obs").agg(F.avg(hit).alias("arrival_prob"))


def classify_arrivals(probabilities: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """TP, FP, FN or TN per observation against the true first positions."""
    births = truth.filter(F.col("obs") == F.col("cluster")).select("obs", F.lit(True).alias("true_arrival"))
    joined = probabilities.join(births, "obs", "left").withColumn(
        "true_arrival", F.coalesce("true_arrival", F.lit(False))
    )
    called = F.col("arrival_prob") >= threshold
    outcome = (
        F.when(called & F.col("true_arrival"), "TP")
        .when(called, "FP")
        .when(F.col("true_arrival"), "FN")
        .otherwise("TN")
    )
    return joined.withColumn("outcome", outcome)


def size_distribution(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many clusters have each size."""
    sizes = assignments.groupBy(*by, "cluster").agg(F.count("*").alias("n_k"))
    return sizes.groupBy(*by, "n_k").agg(F.count("*").alias("clusters"))


def long_trace(trace: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (chain, iteration, parameter)."""
    return trace.unpivot(["chain", "iteration"], list(columns), "parameter", "value")


def unmatched_iterations(draws: DataFrame, trace: DataFrame, by: Sequence[str] = DRAW) -> DataFrame:
    """Iterations present on one side only; must be empty."""
    left = draws.select(*by).distinct()
    right = trace.select(*by).distinct()
    return left.join(right, list(by), "left_anti").withColumn("side", F.lit("draws")).unionByName(
        right.join(left, list(by), "left_anti").withColumn("side", F.lit("trace"))
    )

