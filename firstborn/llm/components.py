"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_reliably


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every id in the edges a, b (bigint).

    Labels fall to the least label next door, then to their label's label, so long chains
    close in about the logarithm of their length.  Every round is written to the shared
    folder; the driver sees one count a round.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    links = persist_reliably(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = persist_reliably(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("component").alias("near")
        )
        fallen = persist_reliably(
            labels.join(near, "id").select("id", "component", F.least("component", "near").alias("new"))
        )
        onward = fallen.select(F.col("id").alias("new"), F.col("new").alias("next"))
        # A label of many ids is one row on the other side; adaptive execution splits its rows.
        jumped = persist_reliably(
            fallen.join(onward, "new").select("id", F.least("new", "next").alias("component"), (F.col("component") != F.least("new", "next")).alias("moved"))
        )
        labels = jumped.select("id", "component")
        if jumped.filter("moved").limit(1).count() == 0:
            return labels
