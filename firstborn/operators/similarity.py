"""Co-occurrence and point estimates over draws, without the n x n matrix.

Observations that share their cluster in every draw of a chain are
interchangeable.  Grouping them into atoms first keeps the summaries exact and
replaces pairs of observations by weighted atoms.

Draws come as one row per observation and draw, or folded: one row per observation with its
``path``.  Folded draws are grouped by path where they lie, and only fingerprints of paths
move, so no shuffle has a row per draw of an observation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import persist_reliably
from .draws import DRAW, is_folded, unfold
from .joins import skew_join

ATOMS_PER_STRIP = 1 << 12
#: Sums of shares may miss a threshold by rounding; this much below it still counts.
SLACK = 1e-9


def observation_paths(draws: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """Each observation's cluster in every draw, as one array ordered by iteration.

    The array length is the number of kept draws, never the size of a cluster.
    """
    if is_folded(draws):
        return draws.select(*by, "obs", "path")
    pairs = F.sort_array(F.collect_list(F.struct("iteration", "cluster")))
    return draws.groupBy(*by, "obs").agg(pairs.alias("path"))


def observation_signatures(draws: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """A 128-bit fingerprint of each observation's labels over the draws.

    Folding hashes keeps one fixed-size row per observation in the shuffle,
    however many draws there are.
    """
    if is_folded(draws):
        return draws.select(*by, "obs", *_path_signature())
    one = F.bit_xor(F.xxhash64("iteration", "cluster"))
    two = F.bit_xor(F.xxhash64(F.lit("second"), "cluster", "iteration"))
    return draws.groupBy(*by, "obs").agg(one.alias("sig_a"), two.alias("sig_b"))


def _path_signature() -> list[Column]:
    return [F.xxhash64("path").alias("sig_a"), F.xxhash64(F.lit("second"), "path").alias("sig_b")]


def _folded_atoms(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of folded draws, each atom's first member, weight, path and fingerprint, written once."""
    grouped = draws.groupBy(*by, "path").agg(F.min("obs").alias("atom"), F.count("*").alias("weight"))
    return persist_reliably(grouped.select(*by, "atom", "weight", "path", *_path_signature()))


def atoms(draws: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """One row per set of interchangeable observations: its first member and size."""
    return (
        observation_signatures(draws, by)
        .groupBy(*by, "sig_a", "sig_b")
        .agg(F.min("obs").alias("atom"), F.count("*").alias("weight"))
    )


def atom_members(draws: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    signed = observation_signatures(draws, by)
    keys = [*by, "sig_a", "sig_b"]
    groups = signed.groupBy(*keys).agg(F.min("obs").alias("atom"), F.count("*").alias("weight"))
    return skew_join(signed, groups, keys, size="weight", spread="obs").select(*by, "obs", "atom")


def atom_draws(draws: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """The draws of each atom's first member, written once: all later work is atom-sized."""
    if is_folded(draws):
        return unfold(_atom_paths(draws, by))
    firsts = atoms(draws, by).select(*by, F.col("atom").alias("obs"), "weight")
    rows = draws.join(firsts, [*by, "obs"])
    return persist_reliably(rows.select(*by, F.col("obs").alias("atom"), "weight", "iteration", "cluster"))


def _atom_paths(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each atom's labels in one array; its length is the number of draws."""
    if is_folded(draws):
        return _folded_atoms(draws, by).select(*by, "atom", "weight", "path")
    path = F.collect_list(F.struct("iteration", "cluster")).alias("path")
    return persist_reliably(atom_draws(draws, by).groupBy(*by, "atom", "weight").agg(path))


def _draw_shares(rows: DataFrame, by: Sequence[str], weights: DataFrame | None) -> DataFrame:
    """The share of every draw in the total weight of its chain, and how many rows it has."""
    draw = [*by, "iteration"]
    per_draw = rows.groupBy(*draw).agg(F.count("*").alias("_rows"))
    per_draw = per_draw.withColumn("w", F.lit(1.0)) if weights is None else per_draw.join(weights, draw)
    total = per_draw.groupBy(*by).agg(F.sum("w").alias("_total"))
    return per_draw.join(total, list(by)).select(*draw, "_rows", (F.col("w") / F.col("_total")).alias("_share"))


def co_occurrence(draws: DataFrame, by: Sequence[str] = ("chain",), weights: DataFrame | None = None) -> DataFrame:
    """Posterior similarity of atoms, upper triangle, zeros left out.

    ``p(i, j)`` of two observations is the value of their atoms (1 inside an
    atom).  ``weights(by, iteration, w)`` weighs the draws; the divisor is the
    total weight, which is the matrix maximum.
    """
    rows = atom_draws(draws, by)
    draw = [*by, "iteration"]
    share = _draw_shares(rows, by, weights)
    left = skew_join(
        rows.select(*draw, "cluster", F.col("atom").alias("atom_a"), F.col("weight").alias("size_a")),
        share,
        draw,
        size="_rows",
        spread="atom_a",
    ).drop("_rows")
    # A cluster of m atoms yields m^2 / 2 pairs, so large ones are cut into strips.
    width = rows.groupBy(*draw, "cluster").agg(F.count("*").alias("_atoms"))
    right = rows.select(*draw, "cluster", F.col("atom").alias("atom_b"), F.col("weight").alias("size_b"))
    right = right.join(width, [*draw, "cluster"])
    pairs = skew_join(
        left, right, [*draw, "cluster"], size="_atoms", spread="atom_a", rows_per_salt=ATOMS_PER_STRIP
    ).filter(F.col("atom_a") <= F.col("atom_b"))
    return pairs.groupBy(*by, "atom_a", "size_a", "atom_b", "size_b").agg(F.sum("_share").alias("p"))


def similar_atoms(
    draws: DataFrame, min_p: float, by: Sequence[str] = ("chain",), weights: DataFrame | None = None
) -> DataFrame:
    """The rows of ``co_occurrence`` with ``p >= min_p`` (up to ``SLACK``), without building the others.

    An atom is the set of its (iteration, cluster) keys, whose shares sum to 1.  Keys are put
    in one order, those with few atoms first.  If two atoms share keys worth ``min_p``, then
    from their first common key on each still has that much left, so only keys with at least
    ``min_p`` from them to the end are listed: the rarest ``1 - min_p`` of every atom's keys.
    Candidates meet in those lists, and whole paths decide.
    """
    if not 0 < min_p <= 1:
        raise ValueError("min_p must be above 0 and at most 1")
    rows = atom_draws(draws, by)
    draw = [*by, "iteration"]
    key = [*draw, "cluster"]
    shared = skew_join(rows, _draw_shares(rows, by, weights), draw, size="_rows", spread="atom").drop("_rows")
    width = rows.groupBy(*key).agg(F.count("*").alias("_width"))
    sized = persist_reliably(skew_join(shared, width, key, size="_width", spread="atom"))
    # As many rows per atom as there are draws; the widest keys come first in the sum.
    rest = W.partitionBy(*by, "atom").orderBy(F.desc("_width"), F.desc("iteration"))
    rest = rest.rowsBetween(W.unboundedPreceding, W.currentRow)
    listed = sized.withColumn("_left", F.sum("_share").over(rest)).filter(F.col("_left") >= min_p - SLACK)
    listed = persist_reliably(listed.select(*key, "atom"))
    lists = listed.groupBy(*key).agg(F.count("*").alias("_listed")).filter("_listed > 1")
    right = listed.join(lists, key).withColumnRenamed("atom", "atom_b")
    met = skew_join(
        listed.withColumnRenamed("atom", "atom_a"), right, key, size="_listed", spread="atom_a", rows_per_salt=ATOMS_PER_STRIP
    ).filter(F.col("atom_a") < F.col("atom_b"))
    met = met.select(*by, "atom_a", "atom_b").distinct()
    path = F.sort_array(F.collect_list(F.struct("iteration", "cluster", F.col("_share").alias("share"))))
    paths = persist_reliably(sized.groupBy(*by, "atom", "weight").agg(path.alias("path")))
    left = paths.select(*by, F.col("atom").alias("atom_a"), F.col("weight").alias("size_a"), F.col("path").alias("_a"))
    other = paths.select(*by, F.col("atom").alias("atom_b"), F.col("weight").alias("size_b"), F.col("path").alias("_b"))
    common = F.zip_with("_a", "_b", lambda x, y: F.when(x["cluster"] == y["cluster"], x["share"]).otherwise(0.0))
    p = F.aggregate(common, F.lit(0.0), lambda acc, v: acc + v)
    apart = met.join(left, [*by, "atom_a"]).join(other, [*by, "atom_b"]).withColumn("p", p)
    columns = [*by, "atom_a", "size_a", "atom_b", "size_b", "p"]
    own = left.select(*by, "atom_a", "size_a", F.col("atom_a").alias("atom_b"), F.col("size_a").alias("size_b"), F.lit(1.0).alias("p"))
    return apart.filter(F.col("p") >= min_p - SLACK).select(*columns).unionByName(own.select(*columns))


def nearest_atoms(
    draws: DataFrame, most: int, min_p: float, by: Sequence[str] = ("chain",), weights: DataFrame | None = None
) -> DataFrame:
    """Each atom's ``most`` other atoms of highest similarity, of at least ``min_p``; the older atom on ties.

    Only the first ``most`` rows of an atom leave a task, so an atom that is similar to all
    others costs no more memory than any other; the result is linear in atoms.
    """
    pairs = similar_atoms(draws, min_p, by, weights).filter(F.col("atom_a") < F.col("atom_b"))
    pairs = persist_reliably(pairs)
    here = pairs.select(*by, F.col("atom_a").alias("atom"), F.col("atom_b").alias("other"), F.col("size_b").alias("size"), "p")
    there = pairs.select(*by, F.col("atom_b").alias("atom"), F.col("atom_a").alias("other"), F.col("size_a").alias("size"), "p")
    order = W.partitionBy(*by, "atom").orderBy(F.desc(F.round("p", 9)), "other")
    ranked = here.unionByName(there).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= most)


def pair_similarity(draws: DataFrame, pairs: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """Co-assignment share of listed observation pairs: two key joins, linear in the list.

    Both sides are keyed by observation, so one large cluster costs nothing extra.  Of folded
    draws the pairs first meet fingerprints, then the paths of atoms.
    """
    labels = F.transform("path", lambda p: p["cluster"])
    same = F.aggregate(
        F.zip_with("_a", "_b", lambda x, y: F.when(x == y, 1).otherwise(0)),
        F.lit(0),
        lambda acc, v: acc + v,
    )
    if is_folded(draws):
        kinds = _folded_atoms(draws, by).select(*by, "sig_a", "sig_b", "weight", labels.alias("_labels"))
        signed = observation_signatures(draws, by)
        joined = pairs
        for side, on in (("a", ["obs_a"]), ("b", [*by, "obs_b"])):
            named = {"obs": f"obs_{side}", "sig_a": f"_{side}1", "sig_b": f"_{side}2", "_labels": f"_{side}", "weight": "_weight"}
            joined = joined.join(signed.withColumnsRenamed(named), on)
        # Labels come last: what is shuffled before them has a few numbers a row.
        for side in ("a", "b"):
            named = {"sig_a": f"_{side}1", "sig_b": f"_{side}2", "_labels": f"_{side}", "weight": "_weight"}
            keys = [*by, f"_{side}1", f"_{side}2"]
            joined = skew_join(joined, kinds.withColumnsRenamed(named), keys, size="_weight", spread=["obs_a", "obs_b"])
            joined = joined.drop("_weight", f"_{side}1", f"_{side}2")
    else:
        paths = observation_paths(draws, by)
        left = paths.select(*by, F.col("obs").alias("obs_a"), labels.alias("_a"))
        right = paths.select(*by, F.col("obs").alias("obs_b"), labels.alias("_b"))
        joined = pairs.join(left, "obs_a").join(right, [*by, "obs_b"])
    return joined.withColumn("together", same.cast("bigint")).withColumn(
        "p", F.col("together") / F.size("_a")
    ).drop("_a", "_b")


def pair_counts(draws: DataFrame, by: Sequence[str] = DRAW) -> DataFrame:
    """Pairs that share a cluster in each draw, counted from sizes."""
    sizes = draws.groupBy(*by, "cluster").agg(F.count("*").alias("n_k"))
    n = F.col("n_k")
    return sizes.groupBy(*by).agg(
        F.sum((n * (n + 1) / 2).cast("bigint")).alias("pairs"), F.max("n_k").alias("largest")
    )


def expected_cluster_mates(draws: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """Row sums of the similarity matrix: mean size of the observation's cluster."""
    from .labels import with_sizes

    if is_folded(draws):
        kinds = _folded_atoms(draws, by)
        key = [*by, "iteration", "cluster"]
        rows = unfold(kinds)
        sizes = rows.groupBy(*key).agg(F.sum("weight").alias("n_k"), F.count("*").alias("_atoms"))
        sized = skew_join(rows, sizes, key, size="_atoms", spread="atom")
        mates = sized.groupBy(*by, "sig_a", "sig_b", "weight").agg(F.avg("n_k").alias("mates"))
        named = skew_join(observation_signatures(draws, by), mates, [*by, "sig_a", "sig_b"], size="weight", spread="obs")
        return named.select(*by, "obs", "mates")
    sized = with_sizes(draws, [*by, "iteration"])
    return sized.groupBy(*by, "obs").agg(F.avg("n_k").alias("mates"))


def contingency(left: DataFrame, right: DataFrame, on: Sequence[str] = ("obs",), by: Sequence[str] = ()) -> DataFrame:
    """Cell counts of two clusterings with labels ``u`` and ``v``."""
    return left.join(right, list(on)).groupBy(*by, "u", "v").agg(F.count("*").alias("cell"))


def adjusted_rand(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index from contingency cells."""

    def chosen(c):
        return c * (c - 1) / 2.0

    row = cells.groupBy(*by, "u").agg(F.sum("cell").alias("_c")).select(*by, "_c", F.lit("u").alias("_side"))
    col = cells.groupBy(*by, "v").agg(F.sum("cell").alias("_c")).select(*by, "_c", F.lit("v").alias("_side"))
    inner = cells.select(*by, F.col("cell").alias("_c"), F.lit("uv").alias("_side"))
    parts = row.unionByName(col).unionByName(inner)

    def total(side, value):
        return F.sum(F.when(F.col("_side") == side, value))

    pairs = chosen(F.col("_c"))
    sums = parts.groupBy(*by).agg(
        total("u", pairs).alias("_u"),
        total("v", pairs).alias("_v"),
        total("uv", pairs).alias("_uv"),
        chosen(total("u", F.col("_c"))).alias("_all"),
    )
    expected = F.col("_u") * F.col("_v") / F.col("_all")
    limit = (F.col("_u") + F.col("_v")) / 2.0
    ari = F.when(limit == expected, F.lit(1.0)).otherwise((F.col("_uv") - expected) / (limit - expected))
    return sums.withColumn("ari", ari).drop("_u", "_v", "_uv", "_all")


def ari_over_draws(truth: DataFrame, draws: DataFrame, by: Sequence[str] = DRAW) -> DataFrame:
    right = truth.select("obs", F.col("cluster").alias("v"))
    if is_folded(draws):
        chain = [c for c in by if c != "iteration"]
        sig = [*chain, "sig_a", "sig_b"]
        paired = observation_signatures(draws, chain).join(right, "obs")
        # Interchangeable observations of one true cluster are counted before their draws are laid out.
        counted = paired.groupBy(*sig, "v").agg(F.count("*").alias("_n"))
        kinds = _folded_atoms(draws, chain).select(*sig, "weight", "path")
        rows = unfold(skew_join(counted, kinds, sig, size="weight", spread="v"))
        cells = rows.groupBy(*by, F.col("cluster").alias("u"), "v").agg(F.sum("_n").alias("cell"))
    else:
        left = draws.select(*by, "obs", F.col("cluster").alias("u"))
        cells = contingency(left, right, ["obs"], by)
    # Read three times: rows, columns, cells.
    return adjusted_rand(persist_reliably(cells), by)


def _draw_cells(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cell counts of every ordered pair of draws, from weighted atoms.

    Each atom pairs its own labels (draws x draws values), so nothing is
    joined on a draw or a cluster.
    """
    crossed = rows.select(*by, "weight", "path", F.explode("path").alias("_c")).select(
        *by, "weight", "_c", F.explode("path").alias("_d")
    )
    return crossed.groupBy(
        *by,
        F.col("_c.iteration").alias("iteration"),
        F.col("_d.iteration").alias("other"),
        F.col("_c.cluster").alias("u"),
        F.col("_d.cluster").alias("v"),
    ).agg(F.sum("weight").alias("cell"))


def binder_losses(draws: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """Expected Binder loss of every draw against the draws of its chain."""

    def chosen(c):
        return c * (c - 1) / 2.0

    cells = persist_reliably(_draw_cells(_atom_paths(draws, by), by))
    within = cells.filter(F.col("iteration") == F.col("other")).groupBy(*by, "iteration").agg(
        F.sum(chosen(F.col("cell"))).alias("_pairs")
    )
    both = cells.groupBy(*by, "iteration", "other").agg(F.sum(chosen(F.col("cell"))).alias("_both"))
    other = within.select(*by, F.col("iteration").alias("other"), F.col("_pairs").alias("_pairs_other"))
    gap = F.col("_pairs") + F.col("_pairs_other") - 2.0 * F.col("_both")
    return (
        both.join(within, [*by, "iteration"])
        .join(other, [*by, "other"])
        .groupBy(*by, "iteration")
        .agg(F.avg(gap).alias("loss"))
    )


def information_losses(draws: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """Lower bound of the expected variation of information of every draw.

    Per observation: log2 of its own cluster's size, plus log2 of its mean
    cluster size over draws, minus twice log2 of its mean overlap.
    """
    rows = _atom_paths(draws, by)
    cells = _draw_cells(rows, by)
    crossed = (
        rows.select(*by, "atom", "weight", "path", F.explode("path").alias("_c"))
        .select(*by, "atom", "weight", "_c", F.explode("path").alias("_d"))
        .select(
            *by,
            "atom",
            "weight",
            F.col("_c.iteration").alias("iteration"),
            F.col("_c.cluster").alias("u"),
            F.col("_d.iteration").alias("other"),
            F.col("_d.cluster").alias("v"),
        )
    )
    # Both sides come from arrays crossed with themselves, which the size Spark expects of them
    # does not count: without the hint one of them may be broadcast.
    overlap = crossed.join(cells.hint("merge"), [*by, "iteration", "other", "u", "v"])
    own = F.sum(F.when(F.col("iteration") == F.col("other"), F.col("cell")))
    per_atom = overlap.groupBy(*by, "atom", "weight", "iteration").agg(
        F.avg("cell").alias("_overlap"), own.alias("_own")
    )
    per_atom = persist_reliably(per_atom)
    mean_size = per_atom.groupBy(*by, "atom").agg(F.avg("_own").alias("_mean"))
    term = F.log2("_own") + F.log2("_mean") - 2.0 * F.log2("_overlap")
    return (
        per_atom.join(mean_size, [*by, "atom"])
        .groupBy(*by, "iteration")
        .agg((F.sum(F.col("weight") * term) / F.sum("weight")).alias("loss"))
    )


def best_draw(losses: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """The draw of least loss, the earliest on ties (losses compared at 9 digits)."""
    key = F.struct(F.round("loss", 9), F.col("iteration"))
    best = F.min_by(F.struct("iteration", "loss"), key)
    return losses.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.iteration", "_b.loss")


def map_draw(trace: DataFrame, burn_in: int = 0, by: Sequence[str] = ("chain",)) -> DataFrame:
    """First iteration of highest log likelihood after burn-in."""
    kept = trace.filter(F.col("iteration") > burn_in)
    best = F.max_by("iteration", F.struct(F.col("log_likelihood"), -F.col("iteration")))
    return kept.groupBy(*by).agg(best.alias("iteration"), F.max("log_likelihood").alias("log_likelihood"))


def take_draw(draws: DataFrame, chosen: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """The clustering of the chosen iteration; ``chosen`` has one row per chain."""
    return draws.join(chosen.select(*by, "iteration"), [*by, "iteration"])
