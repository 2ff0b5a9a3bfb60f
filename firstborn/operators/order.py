"""Positions and running sums without a single-task window.

Rows are numbered by one range exchange.  Once positions are dense, every
running sum is a window inside fixed-width position blocks plus the running sum
of the block totals, so no task ever sorts more than one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import persist_reliably
from .joins import skew_join

BLOCK = 1 << 20
_LOCAL_MASK = (1 << 33) - 1


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    by: Sequence[str] = (),
    name: str = "obs",
    partitions: int | None = None,
) -> DataFrame:
    """Dense positions 1..n in ``order_by`` order, per ``by`` series.

    ``order_by`` must be unique within a series.  Range bounds come from a
    sample, so one hot series or a crowded timestamp is split over many tasks.
    The numbered rows are written once: bounds could differ between two runs
    of the same exchange, and the counts must describe the same split.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order_by]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    split = persist_reliably(ranged.withColumn("_mono", F.monotonically_increasing_id()))
    pid = F.shiftright("_mono", 33)
    local = F.col("_mono").bitwiseAND(F.lit(_LOCAL_MASK))
    # One row per range partition, so both the window and the broadcast are tiny.
    counts = split.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = (
        split.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + local + 1)
        .drop("_mono", "_pid", "_off")
    )
    if not by:
        return placed
    starts = placed.groupBy(*by).agg(
        F.min(name).alias("_first"), F.count("*").alias("_size")
    )
    return (
        skew_join(placed, starts, by, size="_size", spread=name)
        .withColumn(name, F.col(name) - F.col("_first") + 1)
        .drop("_first", "_size")
    )


def running_sums(
    df: DataFrame,
    sums: dict[str, Column | str],
    position: str,
    by: Sequence[str] = (),
    inclusive: bool = False,
    block: int = BLOCK,
    levels: int = 2,
    stored: bool = False,
) -> DataFrame:
    """Running sums of several values along an integer ``position`` axis.

    A block spans ``block`` positions, so it holds at most that many rows of
    any one series; the totals of the blocks are summed the same way one level
    up.  The rows of one series are never gathered in one task.

    The input is read twice (inside blocks, and for their totals), so it is
    written once first unless it is ``stored`` already; chained running sums
    would otherwise repeat everything below them.
    """
    exprs = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    last = 0 if inclusive else -1
    if levels <= 1:
        frame = W.partitionBy(*by).orderBy(position).rowsBetween(W.unboundedPreceding, last)
        return df.withColumns({k: F.coalesce(F.sum(v).over(frame), F.lit(0)) for k, v in exprs.items()})
    if not stored:
        df = persist_reliably(df)
    blk = f"_block{levels}"
    blocked = df.withColumn(blk, F.floor((F.col(position) - 1) / F.lit(block)) + 1)
    frame = W.partitionBy(*by, blk).orderBy(position).rowsBetween(W.unboundedPreceding, last)
    inner = blocked.withColumns(
        {f"_in_{k}": F.coalesce(F.sum(v).over(frame), F.lit(0)) for k, v in exprs.items()}
    )
    totals = blocked.groupBy(*by, blk).agg(*[F.sum(v).alias(f"_tot_{k}") for k, v in exprs.items()])
    offsets = running_sums(
        totals,
        {f"_pre_{k}": f"_tot_{k}" for k in exprs},
        blk,
        by,
        block=block,
        levels=levels - 1,
        stored=True,
    ).drop(*[f"_tot_{k}" for k in exprs])
    return (
        inner.join(offsets, [*by, blk])
        .withColumns({k: F.col(f"_in_{k}") + F.coalesce(F.col(f"_pre_{k}"), F.lit(0)) for k in exprs})
        .drop(blk, *[f"_in_{k}" for k in exprs], *[f"_pre_{k}" for k in exprs])
    )


def segment_ids(
    df: DataFrame, indicator: str, position: str = "obs", by: Sequence[str] = (), name: str = "segment"
) -> DataFrame:
    """Change-point indicators to segment numbers: an inclusive running sum."""
    value = F.col(indicator).cast("bigint")
    return running_sums(df, {name: value}, position, by, inclusive=True, stored=True)


def alive_clusters(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clusters born up to each position, and before it."""
    born = (F.col("obs") == F.col("cluster")).cast("bigint")
    out = running_sums(assignments, {"alive_before": born}, "obs", by, stored=True)
    return out.withColumn("alive", F.col("alive_before") + born)
