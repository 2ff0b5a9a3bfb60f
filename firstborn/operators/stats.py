"""Sufficient statistics per cluster, one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import linear_map, vector_sum
from ..models import CountModel, GaussianModel, TopicModel


def whiten(observations: DataFrame, model: GaussianModel, x: str = "x") -> DataFrame:
    """Replace ``x`` by ``y`` in the basis where the data covariance is the identity."""
    return observations.withColumn("y", linear_map(model.whitening, F.col(x))).drop(x)


def gaussian_stats(rows: DataFrame, model: GaussianModel, by: Sequence[str] = ()) -> DataFrame:
    """Size, per-dimension sum and total square of the whitened members of each cluster."""
    dim = model.dim
    square = vector_sum(dim, lambda i: F.col("y")[i] * F.col("y")[i])
    return rows.groupBy(*by, "cluster").agg(
        F.count("*").alias("n_k"),
        F.array(*[F.sum(F.col("y")[i]) for i in range(dim)]).alias("s"),
        F.sum(square).alias("q"),
    )


def moments(rows: DataFrame, by: Sequence[str] = (), x: str = "x", dim: int = 1) -> DataFrame:
    """Mean vector and total square in the original coordinates."""
    return rows.groupBy(*by, "cluster").agg(
        F.count("*").alias("n_k"),
        F.array(*[F.avg(F.col(x)[i]) for i in range(dim)]).alias("mean"),
        F.sum(vector_sum(dim, lambda i: F.col(x)[i] * F.col(x)[i])).alias("sum_sq"),
    )


def count_stats(terms: DataFrame, assignments: DataFrame, by: Sequence[str] = (), on: Sequence[str] = ("obs",)) -> DataFrame:
    """Total count of every term in every cluster that has it."""
    joined = terms.join(assignments.select(*dict.fromkeys([*by, *on, "cluster"])), list(on))
    return joined.groupBy(*by, "cluster", "term").agg(F.sum("cnt").alias("cnt"))


def count_totals(cluster_terms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cluster_terms.groupBy(*by, "cluster").agg(F.sum("cnt").alias("total"))


def document_topics(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tokens.groupBy(*by, "obs", "topic").agg(F.count("*").alias("cnt"))


def cluster_topics(doc_topics: DataFrame, assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Topic counts per cluster, from the much smaller document-topic counts."""
    joined = doc_topics.join(assignments.select(*by, "obs", "cluster"), [*by, "obs"])
    return joined.groupBy(*by, "cluster", "topic").agg(F.sum("cnt").alias("cnt"))


def topic_terms(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tokens.groupBy(*by, "topic", "term").agg(F.count("*").alias("cnt"))


def dirichlet_posterior(cluster_terms: DataFrame, model: CountModel) -> DataFrame:
    return cluster_terms.withColumn("posterior", F.col("cnt") + model.scale_of(F.col("term")))


def topic_posteriors(topic_counts: DataFrame, word_counts: DataFrame, model: TopicModel) -> tuple[DataFrame, DataFrame]:
    return (
        topic_counts.withColumn("posterior", F.col("cnt") + F.lit(model.topic_parameter)),
        word_counts.withColumn("posterior", F.col("cnt") + F.lit(model.word_parameter)),
    )
