"""Mixing sources to target weights.

Every source's words are packed into fixed-length blocks.  Each output shard draws how many
of its slots every source fills from a multinomial; slots map to blocks through a keyed
pseudorandom permutation of the source's block numbers, and meet the blocks by number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import persist_reliably
from .common import DOCUMENTS, partitions, whole_text

BLOCK_WORDS = 512
SHARD_SLOTS = 4096
#: A mixture names its sources; with more of them, group them first.
MOST_SOURCES = 100_000

_ROUNDS = 4


def permute(index: np.ndarray, size: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..size-1: a balanced Feistel network, repeated until in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in reversed(range(_ROUNDS)) if inverse else range(_ROUNDS):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            if inverse:
                left, right = right ^ (_mix(left, salt) & mask), left
            else:
                left, right = right, left ^ (_mix(right, salt) & mask)
        return left << shift | right

    x = once(np.asarray(index, np.uint64))
    while (far := x >= size).any():
        x[far] = once(x[far])
    return x.astype(np.int64)


def _mix(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x + salt) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, tie (a hash of the text) and size, the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = [len(t.as_py().split()) for t in rows.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "source", "tie")), pa.array(sizes, pa.int64())],
                ["doc_id", "source", "tie", "size"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(whole_text()).alias("tie"),
        whole_text().cast("binary").alias("text"),
    ).mapInArrow(count, "doc_id bigint, source string, tie bigint, size bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source_no, source, source_size and target of every source.

    Weights go round in code-point order of the names, null last.  Targets add up to
    ``share`` of all words; none is above ``most`` times its source: the level at which the
    sources not yet at their limit share what is left by weight.
    """
    # One row per source from here on.
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = totals.withColumn("source_no", number).withColumn(
        "_w", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int"))
    )
    named = named.withColumn("_limit", F.col("source_size") * float(most))
    filling = W.orderBy(F.col("_limit") / F.col("_w"), "source_no")
    full = F.coalesce(F.sum("_limit").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(filling.rowsBetween(0, W.unboundedFollowing))
    wanted = F.sum("source_size").over(W.partitionBy(F.lit(1))) * float(share)
    steps = named.withColumn("_level", (wanted - full) / open_weight)
    level = F.min(F.when(F.col("_level") <= F.col("_limit") / F.col("_w"), F.struct(F.col("_limit") / F.col("_w"), "_level"))).over(
        W.partitionBy(F.lit(1))
    )
    target = F.least(F.col("_limit"), F.coalesce(level["_level"] * F.col("_w"), F.col("_limit")))
    return steps.withColumn("target", target).select("source_no", "source", "source_size", "target")


def word_positions(sizes: DataFrame) -> DataFrame:
    """Adds start: the words of the same source before the row, in doc_id order.

    One range exchange on (source, doc_id) splits a hot source over many tasks.
    """
    spark = sizes.sparkSession
    keys = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "tie"]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, name, total = TaskContext.get().partitionId(), object(), 0
        for rows in batches:
            starts = np.zeros(len(rows), np.int64)
            for i, (source, size) in enumerate(zip(rows["source"], rows["size"], strict=True)):
                if source != name:
                    name, total = source, 0
                starts[i] = total
                total += size
            yield rows.assign(part=part, local=starts)

    split = persist_reliably(
        sizes.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .mapInPandas(local, "doc_id bigint, source string, tie bigint, size bigint, part int, local bigint")
    )
    # At most one row per source and partition that it touches.
    totals = split.groupBy("source", "part").agg(F.sum("size").alias("_n"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        F.col("source").alias("_source"), F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    return (
        split.join(bases, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("start", F.col("_base") + F.col("local"))
        .select("doc_id", "source", "tie", "size", "start")
    )


def _plan(source_size: int, target: float, block: int, key: int) -> tuple[int, int, int]:
    """(blocks, slots, words of the last slot) so that the slots hold the target, to a word."""
    blocks = -(-source_size // block)
    need = round(target)
    if not source_size or not need:
        return blocks, 0, 0
    epochs, rest = divmod(need, source_size)
    short = block * blocks - source_size
    if not rest:
        last = int(permute(np.array([blocks - 1]), blocks, key + epochs - 1)[0])
        return blocks, epochs * blocks, block - short * (last == blocks - 1)
    # Words before the k-th slot of the last round: k blocks, less what the short one lacks.
    at = int(permute(np.array([blocks - 1]), blocks, key + epochs, inverse=True)[0])
    count = -(-rest // block)
    if count > at:
        count = -(-(rest + short) // block)
    before = (count - 1) * block - (short if count - 1 > at else 0)
    return blocks, epochs * blocks + count, rest - before


def mix(
    docs_sizes: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Mix documents given as doc_id, source, tie, size (see ``word_sizes``).

    Returns (documents, spans).  documents: the input with start, source_no, source_size and
    target.  spans: shard, slot, source_no, round, block, and the document part in it:
    doc_id, tie, size, start, first (word of the document) and words.

    Draws of the shards are multinomial by the sources' slots; a source drawn more often than
    its slots passes the surplus, in shard order, to sources drawn less often, so every source
    gets its target to a word and no block is used more than ``most`` times.  All choices
    follow from ``seed``: reruns agree.  Documents without words fill no slot.
    """
    spark = docs_sizes.sparkSession
    placed = word_positions(docs_sizes)
    sources = persist_reliably(source_targets(docs_sizes, weights, share, most))
    named = sources.withColumnRenamed("source", "_source")
    documents = persist_reliably(
        placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    )

    # The recipe: one row per source.
    recipe = sources.select("source_no", "source_size", "target").orderBy("source_no").limit(MOST_SOURCES + 1).toPandas()
    if len(recipe) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    keys = [(seed << 20) + 1009 * i for i in range(len(recipe))]
    plan = [_plan(int(n), float(t), block_words, k) for n, t, k in zip(recipe.source_size, recipe.target, keys, strict=True)]
    blocks = np.array([p[0] for p in plan], np.int64)
    quota = np.array([p[1] for p in plan], np.int64)
    tails = np.array([p[2] for p in plan], np.int64)
    slots = int(quota.sum())
    shards = max(1, -(-slots // shard_slots))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for shard in rows["id"]:
                size = min(shard_slots, slots - shard * shard_slots)
                if size <= 0:
                    continue
                drawn = np.random.default_rng([seed, shard]).multinomial(size, quota / slots)
                at = np.flatnonzero(drawn)
                yield pd.DataFrame({"shard": shard, "source_no": at, "drawn": drawn[at]})

    draws = persist_reliably(spark.range(shards, numPartitions=min(shards, partitions(spark))).mapInPandas(draw, "shard bigint, source_no int, drawn bigint"))
    quotas = spark.createDataFrame(
        pd.DataFrame({"source_no": np.arange(len(quota), dtype=np.int32), "quota": quota}), "source_no int, quota bigint"
    )
    earlier = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("drawn").over(earlier), F.lit(0))
    kept = (
        draws.join(quotas, "source_no")
        .withColumn("first", first)
        .withColumn("kept", F.greatest(F.lit(0), F.least(F.col("drawn"), F.col("quota") - F.col("first"))))
    )
    # What is left over in each shard, in shard order, goes to what the sources still lack.
    left = kept.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("kept")).alias("n")).filter("n > 0")
    running = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    left = left.withColumn("a", F.coalesce(F.sum("n").over(running), F.lit(0)))
    lacking = (
        quotas.join(kept.groupBy("source_no").agg(F.sum("kept").alias("got")), "source_no", "left")
        .withColumn("lack", F.col("quota") - F.coalesce("got", F.lit(0)))
        .filter("lack > 0")
        .withColumn("b", F.coalesce(F.sum("lack").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    low, high = F.greatest("a", "b"), F.least(F.col("a") + F.col("n"), F.col("b") + F.col("lack"))
    # Two tilings of one line: their overlaps are at most shards + sources rows.
    passed = left.join(F.broadcast(lacking), (F.col("a") < F.col("b") + F.col("lack")) & (F.col("b") < F.col("a") + F.col("n"))).select(
        "shard", "source_no", (F.col("quota") - F.col("lack") + low - F.col("b")).alias("first"), (high - low).alias("count")
    )
    runs = kept.filter("kept > 0").select("shard", "source_no", "first", F.col("kept").alias("count")).unionByName(passed)
    inside = W.partitionBy("shard").orderBy("source_no", "first")
    runs = runs.withColumn("at", F.coalesce(F.sum("count").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "shard_size", F.sum("count").over(W.partitionBy("shard"))
    )

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                s, order = r.source_no, np.arange(r.first, r.first + r.count)
                rounds, within = np.divmod(order, blocks[s])
                block = np.empty_like(order)
                for e in np.unique(rounds):
                    block[rounds == e] = permute(within[rounds == e], int(blocks[s]), keys[s] + int(e))
                yield pd.DataFrame(
                    {
                        "shard": r.shard,
                        "slot": permute(np.arange(r.at, r.at + r.count), int(r.shard_size), (seed << 20) + 7 * r.shard),
                        "source_no": s,
                        "round": rounds.astype(np.int32),
                        "block": block,
                        "holds": np.where(order == quota[s] - 1, tails[s], block_words),
                    }
                )

    filled = runs.repartition(partitions(spark), "shard", "source_no", "first").mapInPandas(
        expand, "shard bigint, slot bigint, source_no int, round int, block bigint, holds bigint"
    )
    begin, end = F.col("start"), F.col("start") + F.col("size")
    number = F.explode(F.sequence(F.floor(begin / block_words), F.floor((end - 1) / block_words)))
    parts = documents.filter("size > 0").select("source_no", "doc_id", "tie", "size", "start", number.alias("block"))
    base = F.col("block") * block_words
    parts = parts.withColumn("_from", F.greatest(begin, base)).withColumn("_to", F.least(end, base + block_words))
    taken = F.least(F.col("_to"), base + F.col("holds")) - F.col("_from")
    spans = (
        # Both sides grow with the corpus, whatever the size the planner guesses for the slots.
        parts.join(filled.hint("merge"), ["source_no", "block"])
        .withColumn("words", taken)
        .filter("words > 0")
        .withColumn("first", F.col("_from") - F.col("start"))
        .select("shard", "slot", "source_no", "round", "block", "doc_id", "tie", "size", "start", "first", "words")
    )
    return documents, spans


def taken_words(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the mix, repeats counted) of every document row."""
    taken = spans.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    with_words = documents.filter("size > 0").join(taken, ["source_no", "start"], "left")
    none = documents.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    return (
        with_words.unionByName(none)
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
        .select("doc_id", "size", "source_size", "target", "taken", "source")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for every whole or partial copy that the mix takes.

    Neighbouring spans of one round are joined again, so a document taken whole has its text
    unchanged; a part keeps the text from its first to its last word.  Documents without
    words are in no block and stay, once.  Rows equal in doc_id, source and text stand for
    each other.  n_chars is that of the text given back.
    """
    _, spans = mix(persist_reliably(word_sizes(docs)), **options)
    wanted = spans.groupBy("source_no", "start", "doc_id", "tie", "size").agg(
        F.collect_list(F.struct("round", "first", "words")).alias("spans")
    )
    # Rows with the same id and text: their spans meet again on one copy of the text.
    wanted = wanted.groupBy("doc_id", "tie").agg(F.collect_list("spans").alias("copies"))
    rows = docs.select(*DOCUMENTS).withColumn("tie", F.xxhash64(whole_text()))
    one = rows.groupBy("doc_id", "tie").agg(
        F.first(F.struct("text", "lang", "source", "n_chars")).alias("d"), F.count("*").alias("rows")
    )
    wanted = wanted.withColumnRenamed("doc_id", "_doc").withColumnRenamed("tie", "_tie")
    joined = one.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left").select(
        "doc_id", "d.*", "rows", "copies"
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                words = None if r.text is None else _word_bounds(r.text)
                if words is None or not len(words):
                    out += [(r.doc_id, r.text, r.lang, r.source, r.n_chars)] * r.rows
                    continue
                for copy in r.copies if r.copies is not None else ():
                    for text in _copies(r.text, words, copy):
                        out.append((r.doc_id, text, r.lang, r.source, len(text)))
            frame = pd.DataFrame(out, columns=list(DOCUMENTS))
            yield frame.astype({"doc_id": "Int64", "n_chars": "Int64"})

    return joined.mapInPandas(cut, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def _word_bounds(text: str) -> np.ndarray:
    """Start and end characters of the words."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def _copies(text: str, words: np.ndarray, spans) -> Iterator[str]:
    runs: list[list[int]] = []
    for s in sorted((s["round"], s["first"], s["words"]) for s in spans):
        if runs and runs[-1][0] == s[0] and runs[-1][2] == s[1]:
            runs[-1][2] = s[1] + s[2]
        else:
            runs.append([s[0], s[1], s[1] + s[2]])
    for _, a, b in runs:
        start = 0 if a == 0 else int(words[a, 0])
        end = len(text) if b == len(words) else int(words[b - 1, 1])
        yield text[start:end]
