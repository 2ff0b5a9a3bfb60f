"""Partition priors: stick posteriors, assignment scores and arrival posteriors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import lbeta, lgamma
from ..models import DirichletProcessPrior, StickArrivalPrior
from .order import running_sums


def complement_counts(sizes: DataFrame, by: Sequence[str] = (), levels: int = 2) -> DataFrame:
    """Observations after each birth that joined older clusters: older members minus older positions."""
    out = running_sums(sizes, {"_older": F.col("n_k")}, "cluster", by, levels=levels)
    return out.withColumn("comp", F.col("_older") - (F.col("cluster") - 1)).drop("_older")


def stick_posteriors(sizes: DataFrame, prior: StickArrivalPrior, by: Sequence[str] = (), levels: int = 2) -> DataFrame:
    """Beta posterior of every stick: later members against later members of older clusters."""
    a, b = prior.sticks
    return complement_counts(sizes, by, levels).withColumns(
        {
            "stick_a": F.lit(float(a)) + F.col("n_k") - 1,
            "stick_b": F.lit(float(b)) + F.col("comp"),
        }
    )


def stick_score(prior: StickArrivalPrior):
    """Log Bayes factor of one stick; the first cluster has none."""
    ratio = lbeta(F.col("stick_a"), F.col("stick_b")) - F.lit(prior.log_beta_sticks)
    return F.when(F.col("cluster") > 1, ratio).otherwise(F.lit(0.0))


def arrival_columns(prior: StickArrivalPrior) -> dict:
    p1, p2 = prior.arrivals
    return {
        "arrival_a": F.lit(float(p1)) + F.col("k") - 1,
        "arrival_b": F.lit(float(p2)) + F.col("n") - F.col("k"),
    }


def arrival_score(prior: StickArrivalPrior):
    return lbeta(F.col("arrival_a"), F.col("arrival_b")) - F.lit(prior.log_beta_arrivals)


def partition_shape(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Observations and clusters per partition."""
    return sizes.groupBy(*by).agg(F.sum("n_k").alias("n"), F.count("*").alias("k"))


def arrival_posterior(sizes: DataFrame, prior: StickArrivalPrior, by: Sequence[str] = ()) -> DataFrame:
    shape = partition_shape(sizes, by).withColumns(arrival_columns(prior))
    return shape.withColumn("arrival_score", arrival_score(prior))


def assignment_score(
    sizes: DataFrame,
    prior: StickArrivalPrior | DirichletProcessPrior,
    by: Sequence[str] = (),
    levels: int = 2,
) -> DataFrame:
    """Log probability of each partition under the prior, all partitions in one job."""
    if isinstance(prior, DirichletProcessPrior):
        alpha = float(prior.alpha)
        parts = sizes.groupBy(*by).agg(
            F.sum("n_k").alias("n"),
            F.count("*").alias("k"),
            F.sum(lgamma(F.col("n_k").cast("double"))).alias("_gamma"),
        )
        score = (
            F.col("_gamma")
            + F.col("k") * F.ln(F.lit(alpha))
            + lgamma(alpha)
            - lgamma(F.col("n") + F.lit(alpha))
        )
        return parts.withColumn("assignment_score", score).drop("_gamma")
    sticks = stick_posteriors(sizes, prior, by, levels)
    parts = sticks.groupBy(*by).agg(
        F.sum("n_k").alias("n"), F.count("*").alias("k"), F.sum(stick_score(prior)).alias("stick_score")
    )
    return (
        parts.withColumns(arrival_columns(prior))
        .withColumn("arrival_score", arrival_score(prior))
        .withColumn("assignment_score", F.col("stick_score") + F.col("arrival_score"))
        .drop("arrival_a", "arrival_b")
    )


def log_pmf_triangle(sticks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Log choice probabilities over clusters 1..i for every stage i (``rank`` orders the sticks).

    Cluster j at stage i has ln psi_j plus the complements of the younger
    sticks up to i, a difference of two running sums.
    """
    rest = F.when(F.col("psi") < 1, F.ln(F.lit(1.0) - F.col("psi"))).otherwise(F.lit(0.0))
    cum = running_sums(sticks, {"_cum": rest}, "rank", by, inclusive=True)
    stage = cum.select(*by, F.col("rank").alias("stage"), F.col("_cum").alias("_upto"))
    own = cum.select(*by, F.col("rank").alias("choice"), F.ln("psi").alias("_own"), F.col("_cum").alias("_from"))
    return (
        stage.join(own, list(by))
        .filter(F.col("choice") <= F.col("stage"))
        .select(*by, "stage", "choice", (F.col("_own") + F.col("_upto") - F.col("_from")).alias("log_pmf"))
    )
