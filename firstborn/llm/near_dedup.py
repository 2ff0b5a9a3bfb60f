"""Near duplicates by bottom-k sketches.

One hash function orders all five-word shingles; a document keeps its k least values.
Inverted lists of retained values bring together documents that overlap, the sketch of the
union estimates their similarity, and whole shingle sets decide.  Documents with equal sets
are one class from the start.

Two documents of similarity s share about s*k retained values.  If they hardly ever share
fewer than c, only the rarest k - c + 1 need a list (a prefix filter): values of passages that
many documents quote come last and drop out.  A set of at most k shingles is its own sketch, and the bound
is exact; there the place of a value in both documents' order of rarity must also leave room
for the overlap.  In a list every class is first compared with one leader; after that only
classes still in different components are, if 128 bits of their sets do not keep them apart.
No other pair that could add a link between components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_tables, persist_reliably, table_scope
from .common import SPACES, whole_text
from .components import components

SHINGLE = 5
#: Retained values with inverted lists.
RETAINED = 256
#: Retained values kept for estimates.
SKETCH = 64
#: Linked pairs of more than RETAINED shingles that the prefix filter, and that the estimate, may
#: miss at most, at any threshold.
MISSED, MISSED_ESTIMATE = 2e-8, 1e-6
#: Linked pairs that the bits of sets of more than RETAINED shingles may keep apart at most.
MISSED_BITS = 1e-7
#: Bits of a set that ride along in its lists.
BITS = 128
#: Values are counted by this many hash buckets: a fixed table, whatever the corpus.
BUCKETS = 1 << 22
#: Parts in which the tasks' tables are added up.
PARTS = 64
#: Members of a leader compared in one task.
MEMBERS = 256

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _A
    x = (x ^ x >> np.uint64(27)) * _B
    return x ^ x >> np.uint64(31)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of the whole text if it has fewer words."""
    words = text.lower().split()
    count = len(words)
    if not count:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, count)
    wide = min(SHINGLE, count)
    size = count - wide + 1
    total = np.full(size, wide, np.uint64)
    for i in range(wide):
        total += hashes[i : i + size] * _ODD[i]
    return np.unique(_mix(total))


def set_bits(values: np.ndarray) -> np.ndarray:
    """BITS bits of a set, as two numbers.

    Up to RETAINED shingles: the parity of how many fall on each bit; every bit in which two
    sets differ is a shingle that only one of them has.  Larger sets: whether most shingles
    have the bit in their hash; two sets agree like the signs of two normal variates whose
    correlation is the cosine of the sets.
    """
    if len(values) <= RETAINED:
        odd = np.bincount((values >> np.uint64(57)).astype(np.int64), minlength=BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)
    hashes = np.stack([values, _mix(values ^ _A)], axis=1)
    ones = np.unpackbits(hashes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(values)).view(np.int64)


def _bucket(values: np.ndarray) -> np.ndarray:
    return (_mix(values + _B) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often the retained values of all documents fall in each of the BUCKETS buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for rows in batches:
            for text in rows.column("text"):
                np.add.at(total, _bucket(shingle_set(text.as_py())[:RETAINED]), 1)
        pack = zstandard.ZstdCompressor(level=1).compress
        blobs = [pack(part.tobytes()) for part in np.split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // PARTS, np.int64)
        for blob in table.column("counts"):
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.int64)
        # Only the order of counts matters, so they may stop at the largest int32.
        least = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([least.tobytes()], pa.binary())})

    texts = docs.select(whole_text().cast("binary").alias("text"))
    sums = texts.mapInArrow(count, "part int, counts binary").groupBy("part")
    found = {r.part: r.counts for r in sums.applyInArrow(add, "part int, counts binary").collect()}
    return np.concatenate([np.frombuffer(found[p], np.int32) if p in found else np.zeros(BUCKETS // PARTS, np.int32) for p in range(PARTS)])


@cache
def least_common(size: int, similar: float, missed: float) -> int:
    """What the sketches of ``size`` values of two sets of this similarity share at least, but for a share ``missed`` of pairs.

    The lower tail of a binomial (size, similar): the common values among the least of the union
    are drawn without replacement, which strays less.
    """
    tail, count = 0.0, 0
    while count < size:
        tail += math.comb(size, count) * similar**count * (1 - similar) ** (size - count)
        if tail > missed:
            break
        count += 1
    if not count:
        raise ValueError(f"sketches of {size} values cannot find pairs of similarity {similar}")
    return count


@cache
def most_apart(similar: float) -> int:
    """In how many bits two sets of more than RETAINED shingles differ at most, but for a share MISSED_BITS of pairs."""
    # A Jaccard similarity s means a cosine of at least 2 s / (1 + s).
    p = math.acos(2 * similar / (1 + similar)) / math.pi
    tail, bits = 0.0, BITS
    while bits:
        tail += math.comb(BITS, bits) * p**bits * (1 - p) ** (BITS - bits)
        if tail > MISSED_BITS:
            break
        bits -= 1
    return bits


def listed(size: int, similar: float) -> int:
    """How many of a set's retained values, rarest first, need an inverted list."""
    overlap = int(np.ceil(similar * size - 1e-9))
    # If the other set must fit its sketch too, both sketches are whole sets and the bound is exact.
    if size / similar <= RETAINED:
        return size - overlap + 1
    # A union within the sketch is whole, and only the overlap is sure; of a larger one the sketch shares a sample.
    return min(size, RETAINED) - min(least_common(RETAINED, similar, MISSED), overlap) + 1


def _sketcher(counts: np.ndarray, similar: float):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, keys, sketches, rare, bits = [], [], [], [], []
            for text in rows.column("text"):
                values = shingle_set(text.as_py())
                sizes.append(len(values))
                whole = np.array([values.sum(), _mix(values ^ _A).sum()], np.uint64)
                keys.append(whole.tobytes() if len(values) else None)
                sketches.append(values[:SKETCH].view(np.int64))
                kept = values[:RETAINED]
                order = np.lexsort((kept, counts[_bucket(kept)]))[: listed(len(values), similar) if len(values) else 0]
                rare.append(kept[order].view(np.int64))
                bits.append(set_bits(values))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("tie"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    _lists(sketches), _lists(rare), _lists(bits),
                ],
                ["doc_id", "tie", "n", "key", "sketch", "rare", "bits"],
            )

    return sketch


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def sketches(docs: DataFrame, similar: float) -> DataFrame:
    """doc_id, tie, n (set size), key (128-bit fingerprint), sketch, rare: the values with lists, rarest first, and bits."""
    whole = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole_text()).alias("tie"), whole_text().cast("binary").alias("text")
    )
    counts = bucket_counts(docs)  # BUCKETS numbers of 4 bytes
    return whole.mapInArrow(
        _sketcher(counts, similar), "doc_id bigint, tie bigint, n bigint, key binary, sketch array<bigint>, rare array<bigint>, bits array<bigint>"
    )


def estimated(pairs: DataFrame, classes: DataFrame, similar: float) -> DataFrame:
    """The pairs a, b whose union sketch does not rule them out."""
    least = least_common(SKETCH, similar, MISSED_ESTIMATE) / SKETCH
    left = classes.select(F.col("cid").alias("a"), F.col("sketch").alias("_sa"))
    right = classes.select(F.col("cid").alias("b"), F.col("sketch").alias("_sb"))
    union = F.slice(F.array_sort(F.transform(F.array_union("_sa", "_sb"), _unsigned)), 1, SKETCH)
    both = F.array_intersect(F.transform("_sa", _unsigned), F.transform("_sb", _unsigned))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", union.alias("_u"), both.alias("_i"))
    return joined.filter(F.size(F.array_intersect("_u", "_i")) >= F.size("_u") * least).select("a", "b")


def _unsigned(value):
    # Signed order after this is the order of the unsigned hash values.
    return value.bitwiseXOR(F.lit(-(1 << 63)))


def confirmed(pairs: DataFrame, texts: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """The pairs a, b (b leads) whose whole shingle sets have the similarity.

    A leader's text goes to its members' tasks once per MEMBERS members, so a leader of many
    classes is shared by many tasks.
    """
    part, whole = ratio
    salts = pairs.groupBy("b").agg((F.floor((F.count("*") - 1) / MEMBERS) + 1).alias("_salts"))
    counted = salts.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)).alias("salt"))
    spread = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("_salts"))).drop("_salts")
    members = spread.join(texts.select(F.col("cid").alias("a"), "text"), "a")
    leaders = counted.select(F.col("b").alias("cid"), F.col("salt").alias("share")).join(
        texts.select("cid", F.col("text").alias("leading")), "cid"
    )

    def compare(member: pd.DataFrame, leader: pd.DataFrame) -> pd.DataFrame:
        if not len(leader):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        base = shingle_set(leader["leading"].iloc[0])
        keep = []
        for text in member["text"]:
            values = shingle_set(text)
            common = len(np.intersect1d(base, values, assume_unique=True))
            keep.append(whole * common >= part * (len(base) + len(values) - common))
        return member.loc[keep, ["a", "b"]]

    return members.groupBy("b", "salt").cogroup(leaders.groupBy("cid", "share")).applyInPandas(compare, "a bigint, b bigint")


def _may_link(a: str, b: str, ratio: tuple[int, int], suffix: str = "") -> Column:
    """Whether sizes, and the places of a shared value in both orders of rarity, allow the similarity."""
    part, whole = ratio
    n, m = F.col(f"{a}n"), F.col(f"{b}n{suffix}")
    i, j = F.col(f"{a}place"), F.col(f"{b}place{suffix}")
    sizes = (n * whole >= m * part) & (m * whole >= n * part)
    # The first value that both have leaves at least the overlap behind it in either whole set.
    needed = (n + m) * part
    room = ((n - i) * (part + whole) >= needed) & ((m - j) * (part + whole) >= needed)
    return sizes & (room | (n > RETAINED) | (m > RETAINED))


def _bits_allow(ratio: tuple[int, int]) -> Column:
    """Whether the bits of two sets allow the similarity: surely for small sets, but for MISSED_BITS for large ones."""
    part, whole = ratio
    n, m = F.col("n"), F.col("n_b")
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_b")))
    # Similar sets have at most this many shingles that are not common.
    small = apart * (whole + part) <= (n + m) * (whole - part)
    large = apart <= most_apart(part / whole)
    return F.when((n <= RETAINED) & (m <= RETAINED), small).when((n > RETAINED) & (m > RETAINED), large).otherwise(F.lit(True))


def unsettled(labelled: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Pairs a, b of classes of one list that are in different components and may be similar.

    ``labelled`` has value, band, cid, label (component), n, place, s0 and s1 (its bits).
    """
    mixed = (
        labelled.groupBy("value", "band")
        .agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min(F.struct("place", "cid")).alias("leader"))
        .filter("x <> y")
        .select("value", "band", F.col("leader.cid").alias("leader"))
    )
    # Leaders have been compared with everyone.
    open_lists = labelled.join(mixed, ["value", "band"]).filter("cid <> leader")
    other = open_lists.select("value", "band", *[F.col(c).alias(f"{c}_b") for c in ("cid", "label", "n", "place", "s0", "s1")])
    near = _may_link("", "", ratio, "_b") & _bits_allow(ratio)
    return (
        open_lists.join(other, ["value", "band"])
        .filter((F.col("cid") > F.col("cid_b")) & (F.col("label") != F.col("label_b")) & near)
        .select(F.col("cid").alias("a"), F.col("cid_b").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, ratio: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, tie, n_shingles, component_id and kept of every row.

    Rows are linked if ratio[1] * intersection >= ratio[0] * union of their distinct five-word
    shingles (words are lower-cased in A-Z).  component_id is the least doc_id reachable,
    kept is whether the row has it.  Null, empty and blank texts have no shingles and no
    links: their component is their own id.  Null ids are reached like others, but name a
    component only where every id is null.  Rows with equal ids are kept or not together.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    similar = ratio[0] / ratio[1]
    rows = persist_reliably(sketches(docs, similar))
    classes = persist_reliably(
        rows.filter("n > 0")
        .groupBy("key")
        .agg(
            F.min(F.struct("doc_id", "tie")).alias("at"),
            *[F.first(c).alias(c) for c in ("n", "sketch", "rare")],
            *[F.first(F.col("bits")[i]).alias(f"s{i}") for i in (0, 1)],
        )
        .withColumn("cid", F.monotonically_increasing_id())
    )
    postings = classes.select("cid", "n", F.posexplode("rare").alias("place", "value"))
    lists = postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1").select("value")
    shared = persist_reliably(postings.join(lists, "value"))
    # Sizes of linked sets differ by less than a band, so a pair meets in one band or the next.
    # The margin keeps sizes exactly a band apart from being rounded two bands apart.
    band = F.floor(F.ln("n") / (-np.log(similar) * (1 + 1e-9))).cast("int")
    banded = persist_reliably(shared.withColumn("band", F.explode(F.array(band, band + 1))))
    # The class with the fewest rarer values of its own leads: among edited copies, the original.
    groups = banded.groupBy("value", "band").agg(F.min(F.struct("place", "cid", "n")).alias("leader"), F.count("*").alias("df")).filter("df > 1")
    star = (
        banded.join(groups, ["value", "band"])
        .filter((F.col("cid") != F.col("leader.cid")) & _may_link("", "leader.", ratio))
        .select(F.col("cid").alias("a"), F.col("leader.cid").alias("b"))
        .distinct()
    )
    members = shared.select("cid").distinct()
    wanted = classes.join(members, "cid").select("cid", F.col("at.doc_id").alias("_doc"), F.col("at.tie").alias("tie"))
    raw = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole_text()).alias("tie"), whole_text().cast("binary").alias("text")
    )
    texts = persist_reliably(
        raw.join(wanted, ["tie"]).filter(F.col("doc_id").eqNullSafe(F.col("_doc"))).select("cid", "text").dropDuplicates(["cid"])
    )
    edges = persist_reliably(confirmed(persist_reliably(estimated(star, classes, similar)), texts, ratio))
    found = components(edges)

    # What a leader did not settle: classes of one list that are in different components.
    label = F.coalesce("component", "cid")
    told = classes.select("cid", "s0", "s1").join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", label).drop("component")
    labelled = persist_reliably(banded.join(told, "cid"))
    rest = persist_reliably(estimated(unsettled(labelled, ratio), classes, similar))
    more = persist_reliably(confirmed(rest, texts, ratio))
    final = components(edges.unionByName(more)).withColumnRenamed("id", "cid")
    ids = classes.select("cid", "key", F.col("at.doc_id").alias("least")).join(final, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ids.join(least, "component").select("key", "component_id")
    # A class of many copies is one row of the other side.
    joined = rows.select("doc_id", "tie", "n", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "tie", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_first_of_group(docs: DataFrame, ratio: tuple[int, int] = (85, 100)) -> DataFrame:
    """``docs`` without near duplicates: one row of every component stays, the one of least doc_id.

    Documents without shingles all stay.  Rows that agree in doc_id and text, or share the
    component's id, leave one row; null ids come last.
    """
    names = docs.columns
    with table_scope() as spent:
        judged = near_duplicates(docs, ratio).filter("n_shingles > 0 and kept")
    # Of the rows with the component's id, those with the least hash of the text.
    firsts = judged.groupBy("component_id", "tie").agg(F.count("*").alias("_rows")).groupBy("component_id").agg(
        F.min(F.struct(F.col("tie").alias("_tie"), "_rows")).alias("f")
    )
    firsts = persist_reliably(firsts.select(F.col("component_id").alias("_doc"), "f.*"))
    drop_tables(docs.sparkSession, spent)
    keyed = docs.withColumn("_key", F.xxhash64(whole_text()))
    blank = F.btrim(whole_text(), F.lit(SPACES)) == ""
    chosen = keyed.filter(~blank).join(firsts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_tie")))
    once = chosen.filter("_rows = 1").select(*names)
    repeated = chosen.filter("_rows > 1").dropDuplicates(["doc_id", "_key"]).select(*names)
    return once.unionByName(repeated).unionByName(docs.filter(blank))
