"""Merkle manifest of a document table: node rows of every level, and proofs by a recursive climb.

Leaves are hashed rows in order of (source, doc_id).  Sixteen consecutive nodes of a source
make one of the next level until one is left, the source's subroot; the subroots, in order of
source, make the root the same way.  Every inner node is a row that names its parent and its
place there and holds its children's digests.  A proof is a recursive query over those rows:
it starts from runs of up to sixteen leaves, steps to the parent row, appends the siblings
found there and folds every leaf's digest, until there is no parent.

A digest is the sha256 of the children's digests as lower-case hex text; tables hold it as 32
bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..operators.order import number_rows, running_sums
from ..session import persist_reliably
from .common import DOCUMENTS

FANOUT = 16
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For the climb, node rows are repeated for every 2^BLOCK_BITS leaf positions below them, so
#: that a key of its join has 2^BLOCK_BITS / FANOUT runs and a few at most, the root's as well.
BLOCK_BITS = 16
#: Above these bits a node's number holds its level; levels of the tree of subroots come after.
LEVEL_BITS = 56
TOP = 32
DIGEST = 32


def digest(content: Column) -> Column:
    """32 bytes: the sha256 of a string or of bytes."""
    return F.unhex(F.sha2(content.cast("binary"), 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def parent_digest(digests: Column) -> Column:
    """The digest over concatenated 32-byte digests, taken as hex text."""
    return digest(hex_text(digests))


def encoded(fields: Sequence[Column]) -> Column:
    """Length-prefixed values, so that no two rows encode alike; null is a dash."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


def tampered(doc_id: Column) -> Column:
    """Whether the row's text is altered for the proofs: 5 divides the CRC-32 of the decimal doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and altered: the digest of the row, and of the row with text in lower case if tampered.

    Altered is null where nothing was altered, or where altering left the text as it was.
    """
    rows = docs.select(*DOCUMENTS)
    lowered = F.translate("text", UPPER, UPPER.lower())
    changed = tampered(F.col("doc_id")) & (lowered != F.col("text"))
    field = lambda text: digest(encoded([text if f == "text" else F.col(f) for f in FIELDS]))
    return rows.select("doc_id", "source", field(F.col("text")).alias("leaf"), F.when(changed, field(lowered)).alias("altered"))


@dataclass(frozen=True)
class Manifest:
    """The tables of a tree.

    ``runs``: up to sixteen leaves of a source in order (members), their digests end to end
    (children), its source's number of leaves, and the run's number, parent and place.
    ``nodes``: every inner node's number, level, parent, place, digest, children, and the leaf
    positions lo..hi below it.
    ``subroots``: key (of the source) and digest.  ``root``: digest, one row, none for no leaves.
    """

    runs: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: DataFrame


def _source_key() -> Column:
    """Orders as the UTF-8 bytes of the source, null first."""
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))


def _number(level: int | Column, at: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(level.cast("bigint"), LEVEL_BITS) + at


def _levels(count: int) -> int:
    """Levels above ``count`` nodes until one is left."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FANOUT), levels + 1
    return levels


def _linked(nodes: DataFrame) -> DataFrame:
    """Adds number, parent and place: one of n nodes of its tree and level, or the source's last, or the root."""
    several, top = F.col("n") > 1, F.col("level") >= TOP
    many_sources = F.col("n_sources") > 1
    up = F.when(several, _number(F.col("level") + 1, F.col("base") + F.floor(F.col("at") / FANOUT)))
    over = F.when(~top & many_sources, _number(TOP + 1, F.floor(F.col("no") / FANOUT)))
    place = F.when(several, F.col("at") % FANOUT).when(~top & many_sources, F.col("no") % FANOUT)
    return nodes.withColumns(
        {"number": _number(F.col("level"), F.col("base") + F.col("at")), "parent": F.coalesce(up, over), "place": place.cast("int")}
    )


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """The next level of the trees that have several nodes (base, no, n_sources, n, at); up to FANOUT rows a group."""
    kid = F.struct("at", "digest")
    grouped = (
        nodes.filter("n > 1")
        .groupBy("base", "no", "n_sources", "n", F.floor(F.col("at") / FANOUT).alias("run"))
        .agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    joined = F.aggregate("kids", F.lit(b""), lambda out, k: F.concat(out, k["digest"]))
    return persist_reliably(
        grouped.select(
            F.lit(level).alias("level"), "base", "no", "n_sources", F.ceil(F.col("n") / FANOUT).cast("bigint").alias("n"),
            F.col("run").alias("at"), joined.alias("children"), "lo", "hi",
        ).withColumn("digest", parent_digest(F.col("children")))
    )


def build_manifest(docs: DataFrame) -> Manifest:
    """The tree over rows of doc_id, source, lang, n_chars, text.

    Rows of equal doc_id follow in order of their digest, null ids first; repeated rows are
    leaves of their own, a null source is a source.  Other columns are ignored; no rows give
    empty tables.  Two counts reach the driver: the most leaves of a source, and the sources.
    """
    leaves = persist_reliably(leaf_rows(docs).withColumn("key", _source_key()).drop("source"))
    # Equal rows may stand in any order; the last key only spreads them over partitions.
    told = leaves.withColumn("_row", F.monotonically_increasing_id())
    placed = number_rows(told, ["doc_id", "leaf", "_row"], by=["key"], name="pos").drop("_row")
    member = F.struct("pos", "doc_id", "leaf", "altered")
    cut = persist_reliably(
        placed.groupBy("key", F.floor((F.col("pos") - 1) / FANOUT).alias("at")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    )
    sizes = cut.groupBy("key").agg(F.sum(F.size("members")).alias("leaves"), F.count("*").alias("n"))
    sources = running_sums(number_rows(sizes, ["key"], name="no"), {"base": "leaves"}, "no").withColumn("no", F.col("no") - 1)
    sources = persist_reliably(sources)
    most, count = sources.agg(F.max("leaves"), F.count("*")).first()

    joined = F.aggregate("members", F.lit(b""), lambda out, m: F.concat(out, m["leaf"]))
    runs = skew_join(cut, sources.withColumn("n_sources", F.lit(count)), ["key"], size="n", spread="at")
    runs = runs.withColumns({"level": F.lit(1), "children": joined, "lo": F.col("base") + F.col("at") * FANOUT + 1})
    runs = runs.withColumn("hi", F.col("lo") + F.size("members") - 1)
    runs = runs.withColumn("digest", F.when(F.col("leaves") == 1, F.col("children")).otherwise(parent_digest(F.col("children"))))
    runs = persist_reliably(_linked(runs))

    names = ["level", "base", "no", "n_sources", "n", "at", "children", "lo", "hi", "digest"]
    levels = [runs.select(*names)]
    for level in range(2, 1 + _levels(most or 0)):
        levels.append(_above(levels[-1], level))
    ends = levels[0].filter("n = 1")
    for nodes in levels[1:]:
        ends = ends.unionByName(nodes.filter("n = 1"))
    ends = persist_reliably(ends)
    top = ends.select(
        F.lit(TOP).alias("level"), F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("no"), "n_sources",
        F.col("n_sources").cast("bigint").alias("n"), F.col("no").alias("at"), "children", "lo", "hi", "digest",
    )
    tops = [top]
    for level in range(TOP + 1, TOP + 1 + _levels(count)):
        tops.append(_above(tops[-1], level))
    inner = runs.filter("leaves > 1").select(*names)
    for nodes in [*levels[1:], *tops[1:]]:
        inner = inner.unionByName(nodes)
    nodes = persist_reliably(_linked(inner).select("number", "level", "parent", "place", "digest", "children", "lo", "hi"))
    subroots = sources.select("key", "no", "n").join(ends.select("no", "digest"), "no").select("key", "n", "digest")
    return Manifest(
        runs.select("key", "leaves", "number", "parent", "place", "members", "children", "lo"), nodes, persist_reliably(subroots), tops[-1].select("digest")
    )


CLIMB = """
WITH RECURSIVE climb(run, parent, place, block, folded, above) AS (
  SELECT run, parent, place, block, folded, above FROM {start}
  UNION ALL
  SELECT c.run, n.parent, n.place, c.block,
    transform(c.folded, f -> unhex(sha2(cast(lower(hex(concat(
      substring(n.children, 1, 32 * c.place), f, substring(n.children, 32 * c.place + 33)))) AS binary), 256))),
    concat(c.above, substring(n.children, 1, 32 * c.place), substring(n.children, 32 * c.place + 33))
  FROM climb c JOIN {rungs} n ON n.number = c.parent AND n.block = c.block)
SELECT run, folded, above FROM climb WHERE parent IS NULL LIMIT ALL
"""


def _without(digests: str, place: Column) -> tuple[Column, Column]:
    """The digests before and after a place."""
    left = F.expr(digests).substr(F.lit(1), place * DIGEST)
    return left, F.expr(digests).substr(place * DIGEST + (DIGEST + 1), F.lit(FANOUT * DIGEST))


def climb(manifest: Manifest) -> DataFrame:
    """number (of a run), folded (its leaves' root digests) and above (all siblings above the run, end to end).

    The start folds every leaf, altered where there is an altered digest, into its run; the
    recursive query climbs from there.  A step joins runs with the node rows of one level.
    """
    several = F.col("leaves") > 1

    def folded(m: Column, i: Column) -> Column:
        left, right = _without("children", i)
        own = F.coalesce(m["altered"], m["leaf"])
        return F.when(several, parent_digest(F.concat(left, own, right))).otherwise(own)

    block = F.shiftright("lo", BLOCK_BITS)
    start = manifest.runs.select(
        F.col("number").alias("run"), "parent", "place", block.alias("block"),
        F.transform("members", folded).alias("folded"), F.lit(b"").alias("above"),
    )
    spread = F.explode(F.sequence(block, F.shiftright("hi", BLOCK_BITS)))
    rungs = manifest.nodes.filter("level > 1").select("number", "parent", "place", "children", spread.alias("block"))
    spark = manifest.nodes.sparkSession
    return spark.sql(CLIMB, start=start, rungs=persist_reliably(rungs)).withColumnRenamed("run", "number")


def prove(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, altered, subroot, root, siblings, folded_root and verified of every leaf.

    Digests are hex text; ``siblings`` holds the leaf's siblings, level by level up to the
    root, as one run of bytes.  ``folded_root`` starts from the altered leaf where there is
    one, and ``verified`` is whether it equals the root.
    """
    runs = manifest.runs.select("key", "number", "members", "children").join(climb(manifest), "number")
    runs = skew_join(runs, manifest.subroots.withColumnRenamed("digest", "subroot"), ["key"], size="n", spread="number")
    runs = runs.join(F.broadcast(manifest.root.withColumnRenamed("digest", "root")), F.lit(True))  # one row
    each = runs.select("children", "above", "subroot", "root", F.posexplode(F.arrays_zip("members", "folded")).alias("i", "m"))
    left, right = _without("children", F.col("i"))
    return each.select(
        F.col("m.members.doc_id").alias("doc_id"),
        hex_text(F.col("m.members.leaf")).alias("leaf"),
        hex_text(F.col("m.members.altered")).alias("altered"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"),
        F.concat(left, right, F.col("above")).alias("siblings"),
        hex_text(F.col("m.folded")).alias("folded_root"),
        (F.col("m.folded") == F.col("root")).alias("verified"),
    )
