"""Marginal and predictive densities of the data families, as Columns over statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import constant_at, lgamma, vector_sum
from ..models import CountModel, GaussianModel, TopicModel
from .joins import skew_join
from .prior import assignment_score
from .stats import count_stats, gaussian_stats

LOG_2PI = math.log(2 * math.pi)


def gaussian_precision(model: GaussianModel, n: Column, i) -> Column:
    return n + constant_at(1.0 / model.prior_scale, i)


def gaussian_mean(model: GaussianModel, n: Column, s: Column, i) -> Column:
    shift = constant_at(model.white_mean / model.prior_scale, i)
    return (s[i] + shift) / gaussian_precision(model, n, i)


def gaussian_predictive(model: GaussianModel, y: Column, n: Column, s: Column) -> Column:
    """Log density of one observation under a cluster with size ``n`` and sum ``s``.

    Size 0 gives the predictive of a new cluster.
    """

    def term(i):
        var = F.lit(1.0) + F.lit(1.0) / gaussian_precision(model, n, i)
        gap = y[i] - gaussian_mean(model, n, s, i)
        return F.ln(var) + gap * gap / var

    return F.lit(model.log_det - 0.5 * model.dim * LOG_2PI) - vector_sum(model.dim, term) * 0.5


def gaussian_marginal(model: GaussianModel, n: Column | None = None, s: Column | None = None, q: Column | None = None) -> Column:
    """Log marginal density of a whole cluster from its size, sum and square: ``n_k``, ``s``, ``q`` if not given."""
    if n is None:
        n, s, q = F.col("n_k").cast("double"), F.col("s"), F.col("q")
    prior_square = float((model.white_mean**2 / model.prior_scale).sum())

    def log_scale(i):
        return F.ln(F.lit(1.0) + n * constant_at(model.prior_scale, i))

    def shrunk(i):
        mean = gaussian_mean(model, n, s, i)
        return gaussian_precision(model, n, i) * mean * mean

    return (
        n * F.lit(model.log_det - 0.5 * model.dim * LOG_2PI)
        - vector_sum(model.dim, log_scale) * 0.5
        - (q + F.lit(prior_square) - vector_sum(model.dim, shrunk)) * 0.5
    )


def gaussian_posterior(stats: DataFrame, model: GaussianModel) -> DataFrame:
    """Posterior mean and covariance of each cluster mean in the original coordinates."""
    n, s = F.col("n_k").cast("double"), F.col("s")
    dim = model.dim
    back = np.linalg.inv(model.whitening)

    def combine(weights, parts) -> Column:
        terms = [F.lit(float(w)) * p for w, p in zip(weights, parts) if abs(w) > 1e-300]
        out = terms[0] if terms else F.lit(0.0)
        for t in terms[1:]:
            out = out + t
        return out

    white_mean = [gaussian_mean(model, n, s, i) for i in range(dim)]
    white_var = [F.lit(1.0) / gaussian_precision(model, n, i) for i in range(dim)]
    mean = F.array(*[combine(back[r], white_mean) for r in range(dim)])
    cov = F.array(
        *[combine(back[r] * back[c], white_var) for r in range(dim) for c in range(dim)]
    )
    return stats.withColumns({"post_mean": mean, "post_cov": cov})


def dirichlet_marginal(cluster_terms: DataFrame, model: CountModel, by: Sequence[str] = ()) -> DataFrame:
    """ln B(posterior) - ln B(prior) per cluster; terms the cluster lacks cancel."""
    scale = model.scale_of(F.col("term"))
    gain = lgamma(F.col("cnt") + scale) - lgamma(scale + F.lit(0.0))
    out = cluster_terms.groupBy(*by, "cluster").agg(
        F.sum("cnt").alias("total"), F.sum(gain).alias("_gain")
    )
    total = F.lit(float(model.total))
    score = F.col("_gain") + lgamma(float(model.total)) - lgamma(F.col("total") + total)
    return out.withColumn("log_marginal", score).drop("_gain")


def topic_word_score(word_counts: DataFrame, model: TopicModel, by: Sequence[str] = ()) -> DataFrame:
    """The topic-word term of the likelihood, one row per topic in use (others give 0)."""
    named = word_counts.withColumnRenamed("topic", "cluster")
    words = CountModel(model.num_words, model.word_parameter)
    return dirichlet_marginal(named, words, by).withColumnRenamed("cluster", "topic")


def dirichlet_predictive(
    terms: DataFrame,
    cluster_terms: DataFrame,
    candidates: DataFrame,
    model: CountModel,
    by: Sequence[str] = (),
    leave_out: bool = False,
) -> DataFrame:
    """Dirichlet-multinomial log probability of each observation under its candidates.

    ``candidates(by, obs, cluster, candidate)``.  Only (observation term,
    cluster term) pairs that both exist are joined; everything else is a
    function of totals.  With ``leave_out`` the observation's own counts are
    taken out of its own cluster first.
    """
    scale = model.scale_of(F.col("term"))
    base = terms.groupBy(*by, "obs").agg(
        F.sum("cnt").alias("_size"),
        F.sum(
            lgamma(F.col("cnt") + scale) - lgamma(scale + F.lit(0.0)) - lgamma(F.col("cnt") + F.lit(1.0))
        ).alias("_base"),
    )
    totals = cluster_terms.groupBy(*by, F.col("cluster").alias("candidate")).agg(
        F.sum("cnt").alias("_total")
    )
    own = F.col("cluster") == F.col("candidate")
    # How often each cluster is a candidate decides how its rows are split.
    load = candidates.groupBy(*by, "candidate").agg(F.count("*").alias("_load"))
    totals = load.join(totals, [*by, "candidate"], "left")
    pairs = candidates.join(base, [*by, "obs"], "left")
    pairs = skew_join(pairs, totals, [*by, "candidate"], size="_load", spread="obs").drop("_load")
    pairs = pairs.withColumns(
        {
            "_size": F.coalesce("_size", F.lit(0)),
            "_base": F.coalesce("_base", F.lit(0.0)),
            "_total": F.coalesce("_total", F.lit(0)),
        }
    )
    held = F.col("cnt_k")
    if leave_out:
        held = held - F.when(own, F.col("cnt")).otherwise(F.lit(0))
    held_terms = cluster_terms.select(
        *by, F.col("cluster").alias("candidate"), "term", F.col("cnt").alias("cnt_k")
    ).join(load, [*by, "candidate"])
    both = (
        skew_join(
            candidates.join(terms, [*by, "obs"]), held_terms, [*by, "candidate", "term"], size="_load", spread="obs"
        )
        .withColumn("_held", held)
        .filter(F.col("_held") > 0)
    )
    delta = (
        lgamma(F.col("cnt") + F.col("_held") + scale)
        - lgamma(F.col("_held") + scale)
        - lgamma(F.col("cnt") + scale)
        + lgamma(scale + F.lit(0.0))
    )
    gains = both.groupBy(*by, "obs", "candidate").agg(F.sum(delta).alias("_gain"))
    mass = F.col("_total")
    if leave_out:
        mass = mass - F.when(own, F.col("_size")).otherwise(F.lit(0))
    mass = mass + F.lit(float(model.total))
    score = (
        lgamma(F.col("_size") + F.lit(1.0))
        + F.col("_base")
        + lgamma(mass)
        - lgamma(mass + F.col("_size"))
        + F.coalesce(F.col("_gain"), F.lit(0.0))
    )
    return (
        pairs.join(gains, [*by, "obs", "candidate"], "left")
        .withColumn("log_data", score)
        .drop("_size", "_base", "_total", "_gain")
    )


def joint_score(
    assignments: DataFrame,
    model: GaussianModel | CountModel,
    prior,
    by: Sequence[str],
    data: DataFrame | None = None,
    on: Sequence[str] = ("obs",),
    levels: int = 2,
) -> DataFrame:
    """Joint log likelihood of every clustering named by ``by``, all in one job.

    Gaussian: ``assignments`` carries the whitened ``y``.  Counts: ``data`` is
    the ``(obs, term, cnt)`` table, joined on ``on``.
    """
    if isinstance(model, GaussianModel):
        stats = gaussian_stats(assignments, model, by)
        per_cluster = stats.select(*by, "cluster", "n_k", gaussian_marginal(model).alias("log_marginal"))
        data_part = per_cluster.groupBy(*by).agg(F.sum("log_marginal").alias("data_score"))
        sizes = per_cluster.select(*by, "cluster", "n_k")
    else:
        sizes = assignments.groupBy(*by, "cluster").agg(F.count("*").alias("n_k"))
        per_cluster = dirichlet_marginal(count_stats(data, assignments, by, on), model, by)
        data_part = per_cluster.groupBy(*by).agg(F.sum("log_marginal").alias("data_score"))
    prior_part = assignment_score(sizes, prior, by, levels)
    if by:
        joined = prior_part.join(data_part, list(by), "left")
    else:
        joined = prior_part.join(F.broadcast(data_part), how="left", on=F.lit(True))
    joined = joined.withColumn("data_score", F.coalesce("data_score", F.lit(0.0)))
    return joined.withColumn("joint_score", F.col("assignment_score") + F.col("data_score"))
