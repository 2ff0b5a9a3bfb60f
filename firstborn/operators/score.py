"""Leave-one-out scores of every eligible observation against every candidate cluster.

Nothing is removed or added: taking one observation out changes the stick
posteriors in a way that is known in closed form, so differences of running
sums over the cluster table give each candidate's prior score.  Candidates are
joined per series (``by``); for one long series with very many clusters use
``neighbour_candidates`` instead of all candidates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import lbeta
from ..models import CountModel, DirichletProcessPrior, GaussianModel, StickArrivalPrior
from ..session import persist_reliably
from .joins import skew_join
from .labels import cluster_sizes
from .likelihood import dirichlet_predictive, gaussian_predictive
from .order import running_sums
from .prior import stick_posteriors
from .stats import count_stats, gaussian_stats


def scored_rows(
    assignments: DataFrame, sizes: DataFrame, by: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """Eligible observations, and whether each stands alone."""
    rows = skew_join(assignments, sizes, [*by, "cluster"], size="n_k", spread="obs")
    rows = rows.withColumn("single", (F.col("obs") == F.col("cluster")) & (F.col("n_k") == 1))
    return rows.filter((F.col("obs") > F.col("cluster")) | F.col("single")).select(
        *by, "obs", "cluster", "single", *carry
    )


def candidate_pairs(
    rows: DataFrame,
    clusters: DataFrame,
    by: Sequence[str],
    carry: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Existing clusters that survive the removal, and the new cluster at ``obs``.

    One salted join per series brings everything known about a cluster
    (``extra``) along, so the observation x cluster table is never joined again.
    """
    keep = [*by, "obs", "cluster", "single", *carry]
    total = clusters.groupBy(*by).agg(F.sum("n_k").alias("_rows"), F.count("*").alias("_clusters"))
    sized = skew_join(clusters, total, by, size="_clusters", spread="cluster").select(
        *by, F.col("cluster").alias("candidate"), *extra, "_rows"
    )
    joined = skew_join(rows, sized, by, size="_rows", spread="obs")
    existing = joined.filter(~(F.col("single") & (F.col("candidate") == F.col("obs"))))
    kinds = {f.name: f.dataType for f in clusters.schema.fields}
    new = rows.withColumn("candidate", F.col("obs")).withColumns(
        {c: F.lit(None).cast(kinds[c]) for c in extra}
    )
    return existing.select(*keep, "candidate", F.lit(False).alias("is_new"), *extra).unionByName(
        new.select(*keep, "candidate", F.lit(True).alias("is_new"), *extra)
    )


def _cluster_paths(sizes: DataFrame, prior: StickArrivalPrior, by: Sequence[str]) -> DataFrame:
    """Per cluster: stick posterior and running sums of ln E[1 - psi].

    ``path`` uses the counts as they are, ``path_less`` with one later
    observation taken out of the older clusters.
    """
    a, b = F.col("stick_a"), F.col("stick_b")
    first = F.col("cluster") == 1
    skip = F.when(first, F.lit(0.0)).otherwise(F.ln(b / (a + b)))
    skip_less = F.when(first | (F.col("comp") < 1), F.lit(0.0)).otherwise(F.ln((b - 1) / (a + b - 1)))
    own_less = F.when(first | (F.col("n_k") < 2), F.lit(0.0)).otherwise(F.ln(b / (a + b - 1)))
    sticks = stick_posteriors(sizes, prior, by).withColumns(
        {"skip": skip, "skip_less": skip_less, "own_less": own_less}
    )
    return running_sums(
        sticks,
        {"path": F.col("skip"), "path_less": F.col("skip_less"), "rank": F.lit(1).cast("bigint")},
        "cluster",
        by,
        inclusive=True,
    )


def _position_paths(assignments: DataFrame, paths: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per observation: the running sums over births strictly before it."""
    births = paths.select(
        *by, F.col("cluster").alias("obs"), "skip", "skip_less", F.col("n_k").alias("_born")
    )
    points = assignments.select(*by, "obs").join(births, [*by, "obs"], "left")
    zero = F.lit(0.0)
    out = running_sums(
        points,
        {
            "before": F.coalesce(F.col("skip"), zero),
            "before_less": F.coalesce(F.col("skip_less"), zero),
            "older": F.coalesce(F.col("_born"), F.lit(0)),
            "alive_before": F.col("_born").isNotNull().cast("bigint"),
        },
        "obs",
        by,
    )
    return out.withColumn(
        "alive", F.col("alive_before") + F.col("_born").isNotNull().cast("bigint")
    ).drop("skip", "skip_less", "_born")


def passed_sums(paths: DataFrame, by: Sequence[str]) -> DataFrame:
    """What passing over older clusters costs a group of each size that occurs in the series.

    The cost of a younger cluster's members passing over an older one depends on how many
    they are, not on which cluster it is.  So ``upto`` is a running sum along the ranks per
    *distinct* size: clusters times distinct sizes rows (at most K * sqrt(2n) per series)
    in place of all pairs of clusters.
    """
    total = paths.groupBy(*by).agg(F.count("*").alias("_clusters"))
    sizes = paths.select(*by, F.col("n_k").alias("size")).distinct().join(total, list(by))
    old = paths.select(*by, "rank", "stick_a", "stick_b")
    a, b = F.col("stick_a"), F.col("stick_b")
    gain = lbeta(a, b + F.col("size")) - lbeta(a, b)
    steps = skew_join(old, sizes, by, size="_clusters", spread="rank").select(*by, "size", "rank", gain.alias("_gain"))
    sums = running_sums(
        persist_reliably(steps), {"upto": F.col("_gain")}, "rank", [*by, "size"], inclusive=True, stored=True
    )
    return sums.select(*by, "size", "rank", "upto")


def prior_scores(
    assignments: DataFrame,
    prior: StickArrivalPrior | DirichletProcessPrior,
    by: Sequence[str],
    carry: Sequence[str] = (),
    rebirth: bool = True,
    per_cluster: DataFrame | None = None,
) -> DataFrame:
    """Log prior predictive of each candidate with the observation taken out.

    ``by`` names the series; one long series needs a constant key column.
    ``rebirth=False`` leaves out candidates younger than the observation,
    which is the candidate set the samplers use and needs no cluster pairs.
    Columns of ``per_cluster(by, cluster, ...)`` come along with the candidates.
    """
    if not by:
        raise ValueError("name a series key; a single series takes a constant column")
    # Read for sizes, rows and running sums.
    assignments = persist_reliably(assignments)
    sizes = persist_reliably(cluster_sizes(assignments, by))
    rows = scored_rows(assignments, sizes, by, carry)
    more = [c for c in per_cluster.columns if c not in (*by, "cluster")] if per_cluster is not None else []

    def with_more(clusters: DataFrame) -> DataFrame:
        return clusters if per_cluster is None else clusters.join(per_cluster, [*by, "cluster"])

    if isinstance(prior, DirichletProcessPrior):
        pairs = candidate_pairs(rows, with_more(sizes), by, carry, ["n_k", *more])
        left = F.col("n_k") - (F.col("candidate") == F.col("cluster")).cast("bigint")
        score = F.when(F.col("is_new"), F.lit(math.log(prior.alpha))).otherwise(F.ln(left))
        out = pairs.withColumn("log_prior", score).drop("n_k")
        return out if rebirth else out.filter(F.col("candidate") <= F.col("obs"))

    a0, b0 = (float(v) for v in prior.sticks)
    p1, p2 = (float(v) for v in prior.arrivals)
    paths = persist_reliably(_cluster_paths(sizes, prior, by))
    points = _position_paths(assignments, paths, by)
    shape = sizes.groupBy(*by).agg(F.sum("n_k").alias("_n"), F.count("*").alias("_k"))
    own = skew_join(paths, shape, by, size="_k", spread="cluster").select(
        *by,
        "cluster",
        F.col("path").alias("own_path"),
        F.col("path_less").alias("own_path_less"),
        F.col("skip").alias("own_skip"),
        F.col("own_less").alias("own_less"),
        F.col("n_k").alias("_own_size"),
        "_n",
        "_k",
    )
    placed = rows.join(points, [*by, "obs"])
    placed = skew_join(placed, own, [*by, "cluster"], size="_own_size", spread="obs")
    known = ["before", "before_less", "older", "alive", "own_path", "own_path_less", "own_skip", "own_less"]
    placed = persist_reliably(
        placed.withColumn(
            "_comp", F.col("older") - F.when(F.col("single"), 0).otherwise(1) - (F.col("obs") - 1)
        )
    )
    clusters = with_more(
        paths.select(
            *by,
            "cluster",
            "n_k",
            "rank",
            "stick_a",
            "stick_b",
            F.col("path").alias("k_path"),
            F.col("path_less").alias("k_path_less"),
        )
    )
    extra = ["stick_a", "stick_b", "k_path", "k_path_less", *more]
    if rebirth:
        passed = persist_reliably(passed_sums(paths, by))
        below = passed.select(*by, F.col("size").alias("n_k"), (F.col("rank") + 1).alias("rank"), F.col("upto").alias("_below"))
        clusters = clusters.join(below, [*by, "n_k", "rank"], "left").withColumn("_size", F.col("n_k"))
        extra += ["_size", "_below"]
    joined = candidate_pairs(
        placed,
        clusters,
        by,
        [*carry, *known, "_comp", "_n", "_k"],
        extra,
    )
    obs, c, k, single = F.col("obs"), F.col("cluster"), F.col("candidate"), F.col("single")
    kept = F.col("_k") - single.cast("bigint")
    if rebirth:
        at = passed.select(*by, F.col("size").alias("_size"), F.col("rank").alias("alive"), "upto")
        joined = joined.join(at, [*by, "_size", "alive"], "left").withColumn("passed", F.col("_below") - F.col("upto"))
    else:
        joined = joined.filter(k <= obs).withColumn("passed", F.lit(0.0))
    a_k = F.col("stick_a") - (k == c).cast("double")
    b_k = F.col("stick_b") - ((~single) & (k > c)).cast("double")
    stay = F.when(k > 1, F.ln(a_k) - F.ln(a_k + b_k)).otherwise(F.lit(0.0))
    between = (
        F.when(single, F.col("before") - F.col("k_path"))
        .when(
            k < c,
            F.col("own_path")
            - F.col("own_skip")
            - F.col("k_path")
            + F.col("own_less")
            + F.col("before_less")
            - F.col("own_path_less"),
        )
        .otherwise(F.col("before_less") - F.col("k_path_less"))
    )
    opened = F.when(
        obs > 1, lbeta(F.col("stick_a") + 1.0, F.lit(b0) + F.col("_comp"))
    ).otherwise(F.lit(prior.log_beta_sticks))
    reborn = F.coalesce("passed", F.lit(0.0)) - lbeta(F.col("stick_a"), F.col("stick_b")) + opened
    q1, q2 = F.lit(p1) + kept - 1, F.lit(p2) + F.col("_n") - 1 - kept
    fresh = F.when(kept > 0, F.ln(q1 / (q1 + q2))).otherwise(F.lit(0.0)) + (
        lbeta(F.lit(a0), F.lit(b0) + F.col("_comp")) - F.lit(prior.log_beta_sticks)
    )
    existing = F.when(k < obs, stay + between).otherwise(reborn) + F.ln(q2 / (q1 + q2))
    return joined.select(
        *by,
        "obs",
        "cluster",
        *carry,
        "candidate",
        "is_new",
        *more,
        F.when(F.col("is_new"), fresh).otherwise(existing).alias("log_prior"),
    )


def leave_one_out(
    assignments: DataFrame,
    model: GaussianModel | CountModel,
    prior: StickArrivalPrior | DirichletProcessPrior,
    by: Sequence[str],
    terms: DataFrame | None = None,
    rebirth: bool = True,
) -> DataFrame:
    """Prior plus data score of every candidate, with the observation taken out of both."""
    if isinstance(model, GaussianModel):
        stats = gaussian_stats(assignments, model, by).select(
            *by, "cluster", F.col("n_k").alias("_n_k"), F.col("s").alias("_s")
        )
        joined = prior_scores(assignments, prior, by, ["y"], rebirth, stats)
        own = (~F.col("is_new")) & (F.col("candidate") == F.col("cluster"))
        n = F.when(F.col("is_new"), F.lit(0)).otherwise(F.col("_n_k") - own.cast("int")).cast("double")
        zeros = F.array(*[F.lit(0.0)] * model.dim)
        less = F.zip_with("_s", "y", lambda s, y: s - y)
        s = F.when(F.col("is_new"), zeros).when(own, less).otherwise(F.col("_s"))
        scored = (
            joined.withColumns({"_left": n, "_sum": s})
            .withColumn("log_data", gaussian_predictive(model, F.col("y"), F.col("_left"), F.col("_sum")))
            .drop("_n_k", "_s", "_left", "_sum", "y")
        )
    else:
        # Both are read by several joins below; what counts the terms runs once.
        terms = persist_reliably(terms)
        held = persist_reliably(count_stats(terms, assignments, by, [*by, "obs"]))
        scored = persist_reliably(prior_scores(assignments, prior, by, rebirth=rebirth))
        # A new cluster must not meet the stored counts of the singleton it replaces.
        pairs = scored.filter(~F.col("is_new"))
        fresh = scored.filter(F.col("is_new"))
        old = dirichlet_predictive(terms, held, pairs, model, by, leave_out=True)
        new = dirichlet_predictive(terms, held.filter(F.lit(False)), fresh, model, by)
        scored = old.unionByName(new)
    return scored.withColumn("score", F.col("log_prior") + F.col("log_data"))


def best_candidates(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Highest-scoring candidate per observation; the older one on ties."""
    choice = F.max_by(F.struct("candidate", score), F.struct(score, -F.col("candidate")))
    return (
        scores.groupBy(*by, "obs")
        .agg(choice.alias("_best"))
        .select(*by, "obs", F.col("_best.candidate").alias("best"), F.col(f"_best.{score}").alias("best_score"))
    )
