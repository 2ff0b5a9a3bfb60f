"""Within-cluster distortion, and its curve over the number of k-means clusters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import vector_sum
from ..operators.joins import skew_join
from ..session import persist_reliably

#: Starting sets tried for every number of clusters; the best end counts.
TRIES = 3
STEPS = 20
#: Rows of an Arrow batch whose distances to all centres are held at once.
ROWS_AT_ONCE = 2048


def distortion(rows: DataFrame, dim: int) -> DataFrame:
    """Sum of squared distances to the cluster mean, per cluster.

    Deviations from the mean are joined back rather than differenced from raw
    second moments, which would cancel.
    """
    means = rows.groupBy("cluster").agg(
        F.count("*").alias("n_k"), F.array(*[F.avg(F.col("x")[i]) for i in range(dim)]).alias("mean")
    )
    gap = vector_sum(dim, lambda i: (F.col("x")[i] - F.col("mean")[i]) * (F.col("x")[i] - F.col("mean")[i]))
    return (
        skew_join(rows, means, ["cluster"], size="n_k", spread="x")
        .withColumn("_gap", gap)
        .groupBy("cluster", "n_k")
        .agg(F.sum("_gap").alias("distortion"))
    )


def starting_rows(vectors: DataFrame, most: int, tries: int, seed: int) -> np.ndarray:
    """For each try the ``most`` distinct vectors of smallest hash: (tries, most, dim), fewer if there are fewer."""
    distinct = persist_reliably(vectors.groupBy(F.xxhash64("x").alias("_h")).agg(F.first("x").alias("x")))
    picked = [
        [row.x for row in distinct.orderBy(F.xxhash64(F.lit(seed + t), "_h"), "_h").limit(most).select("x").collect()]
        for t in range(tries)
    ]
    return np.array(picked, dtype=float)


def _partial_sums(centres: np.ndarray, runs: list[slice]):
    """Per Arrow batch and centre: members, their sum, and their squared distances."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norms = (centres**2).sum(axis=1)
        for batch in batches:
            if batch.empty:
                continue
            rows = np.stack(batch["x"].to_numpy()).astype(float)
            count, total = np.zeros(len(centres), dtype=np.int64), np.zeros_like(centres)
            gaps = np.zeros(len(centres))
            for at in range(0, len(rows), ROWS_AT_ONCE):
                part = rows[at : at + ROWS_AT_ONCE]
                scores = norms - 2.0 * part @ centres.T
                for run in runs:
                    near = scores[:, run].argmin(axis=1)
                    member = near[:, None] == np.arange(run.stop - run.start)
                    apart = ((part - centres[run][near]) ** 2).sum(axis=1)
                    total[run] += member.T.astype(float) @ part
                    count[run] += member.sum(axis=0)
                    gaps[run] += apart @ member
            yield pd.DataFrame({"centre": np.arange(len(centres)), "n": count, "total": list(total), "gap": gaps})

    return assign


def elbow_curve(
    vectors: DataFrame, dim: int, ks: Iterable[int], seed: int = 1, tries: int = TRIES, steps: int = STEPS
) -> DataFrame:
    """Total distortion for each number of clusters: Lloyd steps for all numbers and tries at once.

    A step is one pass over the vectors: every row finds its nearest centre in each of the
    runs (a run is one k and one try), and sums per centre are combined before the
    shuffle.  The driver holds the centres only, ``tries * sum(ks) * dim`` numbers.  A centre
    without members stays where it is; steps end early when no centre moves.  Null vectors
    and vectors of another length or with null components take no part.  With fewer distinct
    vectors than k all of them are centres.  A table without vectors has null distortions.
    """
    spark = vectors.sparkSession
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("numbers of clusters start at 1")
    schema = "k INT, distortion DOUBLE"
    whole = (F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull())
    data = persist_reliably(vectors.filter(F.col("x").isNotNull() & whole).select("x"))
    starts = starting_rows(data, ks[-1], tries, seed)
    if starts.size == 0:
        return spark.createDataFrame([(k, None) for k in ks], schema)
    runs, pieces, owner, at = [], [], [], 0
    for k in ks:
        for begin in starts:
            piece = begin[:k]
            runs.append(slice(at, at + len(piece)))
            pieces.append(piece)
            owner.append(k)
            at += len(piece)
    centres = np.concatenate(pieces)
    sums = [F.sum("n").alias("n"), F.sum("gap").alias("gap"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total")]
    for step in range(steps + 1):
        parts = data.mapInPandas(_partial_sums(centres, runs), "centre INT, n BIGINT, total ARRAY<DOUBLE>, gap DOUBLE")
        found = parts.groupBy("centre").agg(*sums).orderBy("centre").collect()
        gaps = np.array([row.gap for row in found])
        moved = np.array([np.array(row.total) / row.n if row.n else centres[row.centre] for row in found])
        if step == steps or np.allclose(moved, centres, rtol=0.0, atol=1e-12):
            break
        centres = moved
    best: dict[int, float] = {}
    for k, run in zip(owner, runs):
        cost = float(gaps[run].sum())
        best[k] = min(cost, best.get(k, cost))
    return spark.createDataFrame([(k, best[k]) for k in ks], schema)
