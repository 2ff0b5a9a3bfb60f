"""Hard-negative mining: exact integer scores by Strassen products of tiles, kept in mergeable heaps.

Anchors are dealt into blocks; a block is held in memory while candidate rows stream past it in
tiles.  A tile's scores are one int64 matrix product by Strassen's recursion, padded with zeros
to a size that halves evenly; its additions are exact.  Two passes: the first keeps, for every
anchor, a heap of its best rows of the same label; the second, for every anchor and positive, a
heap of the best rows of another label inside the window of scores that the positive sets.
Heaps of different tasks merge by keeping the best again.  An anchor and a row of its label
meet in the first pass, in the second they are masked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..session import persist_reliably
from .common import partitions

#: Anchors of a block and candidates of a tile: both sides and the scores take about 10 MB.
ANCHORS = 1024
TILE = 1024
#: Candidates of a block are dealt over stripes of about so many rows, and at least over all tasks.
STRIPE = 1 << 14
#: Strassen's recursion stops at sides of this size.
LEAF = 32
#: Components beyond +-2^26 count as that, so that sums of up to 2^10 products fit 64 bits.
MOST = float(1 << 26)
NONE = np.iinfo(np.int64).min

KEYS = ("dim", "grp", "block", "stripe")


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product of two matrices by seven half-size products a level, exact modulo 2^64.

    Odd shapes are padded with zeros to a multiple of 2^levels, levels taken from the smallest side.
    """
    sides = (*a.shape, b.shape[1])
    levels = 0
    while min(sides) >> (levels + 1) >= leaf:
        levels += 1
    unit = 1 << levels
    n, k, m = (-(-side // unit) * unit for side in sides)
    if levels and (n, k, m) != sides:
        a = np.pad(a, ((0, n - sides[0]), (0, k - sides[1])))
        b = np.pad(b, ((0, k - sides[1]), (0, m - sides[2])))
    return _strassen(a, b, levels)[: sides[0], : sides[2]]


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    (n, k), m, down = a.shape, b.shape[1], levels - 1
    n, k, m = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    out = np.empty((2 * n, 2 * m), np.int64)
    p = _strassen(a11 + a22, b11 + b22, down)
    out[:n, :m], out[n:, m:] = p, p
    p = _strassen(a21 + a22, b11, down)
    out[n:, :m] = p
    out[n:, m:] -= p
    p = _strassen(a11, b12 - b22, down)
    out[:n, m:] = p
    out[n:, m:] += p
    p = _strassen(a22, b21 - b11, down)
    out[:n, :m] += p
    out[n:, :m] += p
    p = _strassen(a11 + a12, b22, down)
    out[:n, :m] -= p
    out[:n, m:] += p
    out[n:, m:] += _strassen(a21 - a11, b11 + b12, down)
    out[:n, :m] += _strassen(a12 - a22, b21 + b22, down)
    return out


class Heaps:
    """The best ``size`` (score, id) of every slot: higher scores first, then smaller ids.

    Offers are pruned by each slot's last kept score, so a slot takes few entries a tile.
    """

    def __init__(self, slots: int, size: int):
        self.size = size
        self.score = np.full((slots, size), NONE, np.int64)
        self.ids = np.full((slots, size), np.iinfo(np.int64).max, np.int64)

    def offer(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Row r of ``scores`` goes to slot slots[r] where allowed; ``ids`` name the columns, ascending."""
        allowed = allowed & (scores >= self.score[slots, -1:])
        rows = np.flatnonzero(allowed.any(axis=1))
        if not rows.size:
            return
        scores, allowed, slots = scores[rows], allowed[rows], slots[rows]
        masked = np.where(allowed, scores, NONE)
        if masked.shape[1] > self.size:
            # The tile's own last score; among its equals only the first ids can stay.
            last = np.partition(masked, -self.size, axis=1)[:, -self.size][:, None]
            equal = allowed & (scores == last)
            allowed = allowed & (scores > last) | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= self.size)
        r, c = np.nonzero(allowed)
        touched, at = np.unique(slots[r], return_inverse=True)
        held = np.repeat(np.arange(len(touched)), self.size)
        self._merge(touched, np.concatenate([held, at]), np.concatenate([self.score[touched].ravel(), scores[r, c]]), np.concatenate([self.ids[touched].ravel(), ids[c]]))

    def _merge(self, touched: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        # ~score orders as -score and has no overflow.
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.searchsorted(slot, np.arange(len(touched)))
        take = starts[:, None] + np.arange(self.size)
        self.score[touched], self.ids[touched] = score[take], ids[take]

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, score and id of all that is held."""
        slot, at = np.nonzero(self.score > NONE)
        return slot, self.score[slot, at], self.ids[slot, at]


def window(positive: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and most whole scores s with low * positive <= s <= high * positive; no product overflows."""

    def share(part: int, whole: int, up: bool) -> np.ndarray:
        q, r = np.divmod(positive, whole)
        return q * part + (-(-r * part // whole) if up else r * part // whole)

    return share(*low, True), share(*high, False)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _streams(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """Rows sorted by KEYS and kind as (key, kind, slices): anchors (kind 0), then tiles (kind 1)."""
    key, kind, parts, rows = None, 0, [], 0
    for batch in batches:
        heads = [batch.column(c).to_numpy() for c in (*KEYS, "kind")]
        change = np.flatnonzero(np.logical_or.reduce([h[1:] != h[:-1] for h in heads])) + 1 if batch.num_rows else []
        for start, stop in zip([0, *change], [*change, batch.num_rows], strict=True):
            if start == stop:
                continue
            now, now_kind = tuple(int(h[start]) for h in heads[:-1]), int(heads[-1][start])
            if parts and (now, now_kind) != (key, kind):
                yield key, kind, parts
                parts, rows = [], 0
            key, kind = now, now_kind
            while start < stop:
                # Anchors of one block stay together; candidates go on as soon as a tile is full.
                step = stop - start if kind == 0 else min(stop - start, TILE - rows)
                parts.append(batch.slice(start, step).select(names))
                start, rows = start + step, rows + step
                if kind == 1 and rows >= TILE:
                    yield key, kind, parts
                    parts, rows = [], 0
    if parts:
        yield key, kind, parts


def _joined(parts: list[pa.RecordBatch], name: str):
    return pa.chunked_array([p.column(name) for p in parts]).combine_chunks()


def _heap_maker(size: int, windows: tuple[tuple[int, int], tuple[int, int]] | None):
    """Arrow function over sorted streams: the heaps of each block and stripe.

    Without ``windows`` candidates share the label of the block's anchors and slots are anchors;
    with them anchors carry the scores of their positives, and slots are anchor times positive.
    """
    names = ("row", "vec_id", "label", "v", "positives")

    def tile(held: dict, parts: list[pa.RecordBatch]) -> None:
        ids = _joined(parts, "vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        scores = strassen(held["v"], np.ascontiguousarray(_matrix(_joined(parts, "v"), held["dim"])[order].T))
        if windows is None:
            held["heaps"].offer(np.arange(len(scores)), scores, held["vec_id"][:, None] != ids, ids)
            return
        other = held["label"][:, None] != _joined(parts, "label").to_numpy()[order]
        other &= held["vec_id"][:, None] != ids
        for slot, (anchor, low, high) in enumerate(held["slots"]):
            s = scores[anchor]
            inside = (s >= low[:, None]) & (s <= high[:, None]) & other[anchor]
            held["heaps"].offer(held["first"][slot] + np.arange(len(anchor)), s, inside, ids)

    def anchors(dim: int, parts: list[pa.RecordBatch]) -> dict:
        held = {"dim": dim, "row": _joined(parts, "row").to_numpy(), "vec_id": _joined(parts, "vec_id").to_numpy()}
        held |= {"label": _joined(parts, "label").to_numpy(), "v": _matrix(_joined(parts, "v"), dim)}
        if windows is None:
            return held | {"heaps": Heaps(len(held["row"]), size)}
        lists = _joined(parts, "positives")
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        begin = np.cumsum(counts) - counts
        slots, first, row, score = [], [], [], []
        for k in range(counts.max(initial=0)):  # the k-th positive of every anchor that has one
            at = np.flatnonzero(counts > k)
            first.append(sum(map(len, row)))
            row.append(at)
            score.append(flat[begin[at] + k])
            slots.append((at, *window(score[-1], *windows)))
        owner = np.concatenate(row) if row else np.empty(0, np.int64)
        rank = np.concatenate([np.full(len(r), k) for k, r in enumerate(row)]) if row else owner
        return held | {"slots": slots, "first": first, "owner": owner, "rank": rank, "heaps": Heaps(len(owner), size)}

    def result(held: dict) -> pa.RecordBatch:
        slot, score, ids = held["heaps"].kept()
        owner = slot if windows is None else held["owner"][slot]
        rank = np.zeros(len(slot), np.int32) if windows is None else held["rank"][slot].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(held["row"][owner]), pa.array(rank), pa.array(ids), pa.array(score)], ["row", "slot", "other_id", "score"]
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for now, kind, parts in _streams(batches, names):
            if now != key:
                if held is not None:
                    yield result(held)
                key, held = now, None
            if kind == 0:
                held = anchors(now[0], parts)
            elif held is not None:  # a stripe may have rows for a block that has no anchors
                tile(held, parts)
        if held is not None:
            yield result(held)

    return make


def integer_vectors(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and v (integers floor(256 x)) of the rows that take part."""
    x = F.col("embedding")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.transform(x, lambda e: F.greatest(F.least(F.floor(e.cast("double") * 256).cast("double"), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), "embedding")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & sound)
    return rows.select("vec_id", "label", whole.alias("v"), F.size("embedding").alias("dim"))


def _dealt(anchors: DataFrame, candidates: DataFrame, maker) -> DataFrame:
    """Heaps of every block and stripe, from anchors and candidates with the columns of ``KEYS``."""
    stacked = anchors.withColumn("kind", F.lit(0)).unionByName(candidates.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    order = [*KEYS, "kind"]
    return (
        stacked.select(*order, "row", "vec_id", "label", "v", "positives")
        .repartition(partitions(anchors.sparkSession), *KEYS)
        .sortWithinPartitions(*order)
        .mapInArrow(maker, "row bigint, slot int, other_id bigint, score bigint")
    )


def _best(heaps: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Merged heaps: the first ``size`` of each key, with their rank from 1."""
    first = W.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return heaps.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= size)


def mine_hard_negatives(
    vectors: DataFrame,
    label: Column,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: tuple[int, int] = (3, 10),
    high: tuple[int, int] = (9, 10),
    block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and what ``label`` and ``anchor`` read.  Scores are inner
    products of floor(256 x) with the anchor.  An anchor's positives are its first ``positives``
    rows of the same label, by score, then smaller id; each positive's negatives are the first
    ``negatives`` rows of another label whose score s satisfies low * p <= s <= high * p.

    Rows with a null id or label, and null, empty or unsound vectors take no part.  Vectors of
    different length do not meet.  Rows of one vec_id never meet each other; as candidates each
    counts, repeated anchor rows (equal id, label and vector) are one anchor.  Components beyond
    +-2^26 count as that.  No rows, or no anchors, give no rows; other columns are ignored.
    """
    tasks = partitions(vectors.sparkSession)
    rows = integer_vectors(vectors, label).withColumns({"asks": anchor, "place": F.monotonically_increasing_id()})
    rows = persist_reliably(rows)
    asked = rows.filter("asks").select("vec_id", "label", "v", "dim").distinct()
    asked = persist_reliably(asked.withColumn("row", F.monotonically_increasing_id()))

    def plan(questions: DataFrame, answers: DataFrame) -> DataFrame:
        """Blocks and stripes of every (dim, grp) that has questions; small next to its rows."""
        asks = questions.groupBy("dim", "grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        sizes = answers.groupBy("dim", "grp").agg(F.count("*").alias("n"))
        total = answers.agg(F.count("*").alias("total"))  # one row
        planned = asks.join(sizes, ["dim", "grp"]).join(F.broadcast(total), F.lit(True))
        fair = F.col("n") * (2 * tasks) / F.col("total") / F.col("blocks")
        stripes = F.greatest(F.ceil(F.col("n") / STRIPE), F.ceil(fair)).cast("int")
        return persist_reliably(planned.select("dim", "grp", "blocks", stripes.alias("stripes"), "n"))

    def heaps(questions: DataFrame, answers: DataFrame, maker) -> DataFrame:
        planned = plan(questions, answers)
        all_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        one_of = lambda name, by: F.pmod(F.xxhash64(by), F.col(name)).cast("int")
        held = questions.join(planned, ["dim", "grp"]).withColumns({"block": one_of("blocks", "row"), "stripe": all_of("stripes")})
        streamed = skew_join(answers, planned, ["dim", "grp"], size="n", spread="place")
        streamed = streamed.withColumns({"block": all_of("blocks"), "stripe": one_of("stripes", "place")})
        return _dealt(held.drop("place"), streamed, maker)

    # First pass: blocks of anchors with one length and label; rows meet the blocks of theirs.
    by_label = lambda df: df.withColumn("grp", F.col("label"))
    nothing = F.lit(None).cast("array<bigint>")
    first = heaps(by_label(asked).withColumn("positives", nothing), by_label(rows), _heap_maker(positives, None))
    found = persist_reliably(
        _best(first, ["row"], positives).select("row", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank")
    )

    # Second pass: blocks of anchors with one length; every row of that length meets them all.
    lists = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
    asking = persist_reliably(asked.join(lists, "row").withColumn("positives", F.col("p.positive_score")).drop("p"))
    by_length = lambda df: df.withColumn("grp", F.lit(0).cast("bigint"))
    heaped = heaps(by_length(asking), by_length(rows), _heap_maker(negatives, (low, high)))
    second = _best(heaped, ["row", "slot"], negatives)
    mined = second.select("row", (F.col("slot") + 1).alias("_of"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.withColumnRenamed("rank", "_of").join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return mined.join(named, ["row", "_of"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
