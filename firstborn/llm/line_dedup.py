"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line's tokens are its distinct five-word shingles (a shorter line is one token).  Tokens are
put in order of rarity, and only a prefix of each line is indexed: two lines with Jaccard
similarity of at least the threshold must share a token of both prefixes.  Length and
positional filters thin the pairs, whole token sets decide, and a line that matches an
earlier one is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.joins import skew_join
from ..session import drop_tables, persist_reliably, table_scope
from .common import SPACES, WORD_BREAK, whole_text
from .outliers import let

#: Similarity from which a line repeats another, as a ratio of integers.
SIMILAR = (4, 5)
SHINGLE = 5
#: Tokens are counted by this many hash buckets: a fixed table, whatever the corpus.
BUCKET_BITS = 14

#: Documents are told apart by this many hash bits before a join on them.
FILTER_BITS = 20

_LOW = (1 << BUCKET_BITS) - 1


def line_shingles(line: Column) -> Column:
    """Hashes of the line's five-word shingles; of the whole line if it has fewer words; none without words."""

    def hashes(words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))),
            lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))),
        )

    trimmed = F.btrim(line, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(let(F.split(trimmed, WORD_BREAK), hashes))


def token_ranks(docs: DataFrame) -> DataFrame:
    """One row with ranks: the place of every hash bucket, the least used first."""
    spark = docs.sparkSession
    tokens = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(line_shingles(F.col("line"))).alias("t"))
    counts = tokens.groupBy(F.col("t").bitwiseAND(F.lit(_LOW)).alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.range(1 << BUCKET_BITS).withColumnRenamed("id", "bucket")
    # A fixed number of rows from here on.
    ranked = every.join(F.broadcast(counts), "bucket", "left").select(
        "bucket", (F.row_number().over(W.orderBy(F.coalesce("n", F.lit(0)), "bucket")) - 1).alias("rank")
    )
    return ranked.agg(F.array_sort(F.collect_list(F.struct("bucket", "rank"))).alias("r")).select(F.col("r.rank").alias("ranks"))


def ordered_tokens(line: Column, ranks: Column) -> Column:
    """Distinct tokens, rarest first: the bucket's rank on top of the other bits of the hash, sorted.

    Ranks are centred at zero, so that the order of signed numbers is the order of ranks.
    """
    centred = lambda h: F.get(ranks, h.bitwiseAND(F.lit(_LOW)).cast("int")).cast("bigint") - (1 << (BUCKET_BITS - 1))
    keyed = F.transform(
        line_shingles(line), lambda h: F.shiftleft(centred(h), 64 - BUCKET_BITS).bitwiseOR(F.shiftrightunsigned(h, BUCKET_BITS))
    )
    return F.sort_array(F.array_distinct(keyed))


def _ceil_share(n: Column, a: int, b: int) -> Column:
    return F.floor((n * a + (b - 1)) / b).cast("int")


def _bucket(doc_id: str, tie: str) -> Column:
    return F.xxhash64(doc_id, tie).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def touched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` (doc_id, tie, ...) that may be among ``keys`` (doc_id, tie), or surely are not.

    A filter of at most 2^FILTER_BITS bucket numbers is broadcast, so most other rows never
    reach a shuffle; rows that share a bucket are sorted out by the join after it.
    """
    buckets = keys.select(_bucket("doc_id", "tie").alias("_b")).distinct()
    return docs.join(F.broadcast(buckets), _bucket("doc_id", "tie") == F.col("_b"), how)


def _named(pairs: DataFrame) -> DataFrame:
    """The classes of either side."""
    return pairs.select("k1").unionByName(pairs.select(F.col("k1_b").alias("k1"))).distinct()


def _line_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """at, k1 and the token set of the first line of every class in ``wanted`` (k1), from the texts."""
    firsts = classes.join(wanted, "k1", "left_semi").select("k1", F.col("first").alias("at"))
    by_doc = firsts.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.tie").alias("tie")).agg(
        F.collect_list(F.struct(F.col("at.no").alias("no"), "k1")).alias("picked")
    )
    by_doc = persist_reliably(by_doc)
    named = by_doc.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), "picked")
    line = lambda p: F.struct(p["no"].alias("no"), p["k1"].alias("k1"), F.get("lines", p["no"]).alias("line"))
    return (
        touched(docs, by_doc, "left_semi")
        .join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")))
        .select("doc_id", "tie", "picked", F.split("text", "\n").alias("lines"))
        .select("doc_id", "tie", F.explode(F.transform("picked", line)).alias("p"))
        .select(F.struct("doc_id", "tie", "p.no").alias("at"), "p.k1", F.array_distinct(line_shingles(F.col("p.line"))).alias("tokens"))
    )


def removed_lines(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, tie and removed (line numbers from 0) of the documents that lose lines.

    ``docs`` has doc_id, tie (a hash of the text) and text.  Lines are in order of (doc_id,
    tie, number), null ids first; a line goes if any earlier line has similarity of at least
    ``similar``, removed itself or not.
    """
    a, b = similar
    ranks = F.broadcast(persist_reliably(token_ranks(docs)))  # one row of fixed size
    tokens = F.transform(
        F.split("text", "\n"),
        lambda line: let(
            ordered_tokens(line, F.col("ranks")),
            lambda t: F.struct(
                F.size(t).alias("n"),
                F.xxhash64(t).alias("k1"),
                F.xxhash64(F.lit(1), t).alias("k2"),
                F.slice(t, F.lit(1), F.size(t) - _ceil_share(F.size(t), a, b) + 1).alias("prefix"),
            ),
        ),
    )
    lines = persist_reliably(
        docs.crossJoin(ranks)
        .select("doc_id", "tie", F.posexplode(tokens).alias("no", "l"))
        .filter("l.n > 0")
        .select("doc_id", "tie", "no", "l.*")
    )
    at = F.struct("doc_id", "tie", "no")
    # Equal sets are one class; its first line stays unless an earlier class is similar.
    classes = persist_reliably(
        lines.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min(at).alias("first"), F.count("*").alias("copies"))
    )
    postings = classes.select("k1", "n", F.posexplode("prefix").alias("i", "token"))
    lists = persist_reliably(postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    # First lines join only what is left: most tokens are in one class and end here.
    met_again = skew_join(postings, lists, ["token"], size="df", spread="k1")
    shared = persist_reliably(met_again.join(classes.select("k1", "first"), "k1"))

    def near(old: DataFrame, new: DataFrame) -> DataFrame:
        """Pairs of classes (k1 earlier, k1_b later) that meet in a list and pass the filters."""
        right = new.select(*[F.col(c).alias(f"{c}_b") for c in ("token", "k1", "n", "i", "first")])
        n_a, n_b, i_a, i_b = (F.col(c) for c in ("n", "n_b", "i", "i_b"))
        # |A and B| >= a / (a + b) * (|A| + |B|) is what the similarity asks for; the first common
        # token must leave that many behind it in both orders.
        needed = (n_a + n_b) * a
        met = skew_join(right.withColumnRenamed("token_b", "token"), old, ["token"], size="df", spread="k1_b")
        return (
            met.filter((F.col("first") < F.col("first_b")) & (n_a * b >= n_b * a) & (n_b * b >= n_a * a))
            .filter(((n_a - i_a) * (a + b) >= needed) & ((n_b - i_b) * (a + b) >= needed))
            .select("k1", "k1_b")
            .distinct()
        )

    def beaten(pairs: DataFrame, fetched: DataFrame) -> DataFrame:
        """k1 and first of the later classes whose whole sets are similar to the earlier one's."""
        other = fetched.select(F.col("at").alias("at_b"), F.col("k1").alias("k1_b"), F.col("tokens").alias("tokens_b"))
        both = F.size(F.array_intersect("tokens", "tokens_b"))
        return (
            pairs.join(fetched, "k1")
            .join(other, "k1_b")
            .filter(both * (a + b) >= (F.size("tokens") + F.size("tokens_b")) * a)
            .select(F.col("k1_b").alias("k1"), F.col("at_b").alias("first"))
            .distinct()
        )

    # Every list is compared with its first class to begin with, which settles groups of near
    # copies in as many pairs as they have members.
    heads = shared.groupBy("token").agg(F.min(F.struct("first", "k1"))["k1"].alias("head"))
    led = persist_reliably(skew_join(shared, heads.join(lists, "token").withColumnRenamed("df", "_df"), ["token"], size="_df", spread="k1").drop("_df"))
    is_head = F.col("k1") == F.col("head")
    begun = persist_reliably(near(led.filter(is_head), led.filter(~is_head)))
    known = persist_reliably(_line_sets(docs, classes, _named(begun)))
    settled = persist_reliably(beaten(begun, known))
    # What no head removed meets every other earlier class of its lists, removed or not.
    rest = led.filter(~is_head)
    left = persist_reliably(
        near(rest, rest.join(settled.select("k1").distinct(), "k1", "left_anti")).join(begun, ["k1", "k1_b"], "left_anti")
    )
    more = _line_sets(docs, classes, _named(left).join(known.select("k1").distinct(), "k1", "left_anti"))
    linked = settled.unionByName(beaten(left, persist_reliably(known.unionByName(more)))).distinct()
    gone = classes.select("k1", "k2", "first").join(linked, ["k1", "first"]).select("k1", "k2", F.lit(True).alias("gone"))
    starts = classes.select("k1", "k2", "first", "copies").join(gone, ["k1", "k2"], "left")
    # Only classes with later copies or a similar earlier class lose lines.
    losing = starts.filter(F.col("gone") | (F.col("copies") > 1)).select("k1", "k2", "first", "gone")
    # A class of a very common line has many rows here, but one row on the other side.
    again = lines.select("doc_id", "tie", "no", "k1", "k2").join(losing, ["k1", "k2"]).filter(F.col("gone") | (at > F.col("first")))
    return again.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("no")).alias("removed"))


def dedup_lines(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``docs`` with the lines removed that repeat an earlier line, and removed, their number.

    Lines end at line feeds; what stays is joined by line feeds again.  Lines without words
    always stay.  A document that loses no line keeps its text as it is, null included.
    Rows with equal doc_id and text stand for each other: they lose the same lines, and not
    to one another.  An empty table gives no rows.  Other columns pass through.
    """
    names = docs.columns
    slim = docs.select("doc_id", F.xxhash64(whole_text()).alias("tie"), whole_text().alias("text"))
    with table_scope() as spent:
        found = removed_lines(slim, similar)
    gone = persist_reliably(found)
    drop_tables(docs.sparkSession, spent)
    keyed = docs.select(F.struct(*names).alias("row"), "doc_id", F.xxhash64(whole_text()).alias("tie"))
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains(F.col("removed"), i)), "\n")
    named = gone.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), "removed")
    maybe = touched(keyed, gone, "left_semi").join(
        named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left"
    )
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    changed = maybe.select(
        *[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names], F.coalesce(F.size("removed"), F.lit(0)).alias("removed")
    )
    same = touched(keyed, gone, "left_anti").select("row.*", F.lit(0).alias("removed"))
    return changed.unionByName(same)
