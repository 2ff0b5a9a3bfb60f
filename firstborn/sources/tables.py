"""Readers and writers of the tables the operators use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import canonical_labels
from ..operators.order import number_rows
from ..session import persist_reliably


def ordered_observations(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows in order become observations 1..n (per series)."""
    return number_rows(df, order_by, by)


def assigned_observations(
    df: DataFrame, order_by: Sequence[str], label: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Ordered observations with the canonical cluster of their label, written once."""
    return persist_reliably(canonical_labels(number_rows(df, order_by, by), label, by))


def count_table(rows: DataFrame, keys: Sequence[str], term: Column, cnt: Column | None = None) -> DataFrame:
    """Sparse counts: one row per key and term."""
    value = F.count("*") if cnt is None else F.sum(cnt)
    return rows.groupBy(*keys, term.alias("term")).agg(value.cast("bigint").alias("cnt"))


def words(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per single-space token of the whole text, with its place in the text."""
    return texts.select(
        *keys, F.posexplode(F.split(F.lower(text), " ", -1)).alias("place", "term")
    ).filter(F.col("term") != "")


def term_counts(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return count_table(words(texts, keys, text), keys, F.col("term"))


def from_wide(df: DataFrame, order_by: Sequence[str], cluster: str, columns: Sequence[str]) -> DataFrame:
    """A wide labelled frame to ``(obs, cluster, x)`` with canonical clusters."""
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    slim = df.select(*dict.fromkeys([*order_by, cluster]), x)
    renamed = slim.withColumnRenamed(cluster, "_label") if cluster not in order_by else slim.withColumn("_label", F.col(cluster))
    numbered = number_rows(renamed, order_by)
    return canonical_labels(numbered, ["_label"]).select("obs", "cluster", "x")


def long_values(observations: DataFrame) -> DataFrame:
    return observations.select("obs", "cluster", F.posexplode("x").alias("dim", "value"))


#: Stands for a null text in a clustering file, where an empty text is an empty field.
NULL_TEXT = "\\N"


def read_clustering_csv(spark: SparkSession, path: str) -> DataFrame:
    """A clustering result: timestamp, quoted multi-line text, cluster."""
    return (
        spark.read.schema("timestamp STRING, tweet STRING, cluster BIGINT")
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", NULL_TEXT)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_clustering_csv(df: DataFrame, path: str) -> None:
    """Many quoted files: a multi-line file cannot be split on reading."""
    (
        df.select("timestamp", "tweet", "cluster")
        .write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("nullValue", NULL_TEXT)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_iterations(rows: DataFrame, path: str) -> None:
    """Add draws or trace rows by (iteration, chain); writing an iteration again replaces it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration", "chain").parquet(path)


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("iteration INT, obs BIGINT, cluster BIGINT, chain INT").parquet(path)
