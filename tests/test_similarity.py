"""Thresholds and nearest atoms against the whole similarity table, re-birth sums against pairs of clusters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firstborn.functions.variates import log_gammas
from firstborn.models import StickArrivalPrior
from firstborn.operators import score, similarity
from firstborn.operators.labels import canonical_labels, cluster_sizes, keep_iterations
from firstborn.plans.elbow import elbow_curve, starting_rows


@pytest.fixture(scope="module")
def draws(spark):
    """Two chains of 10 draws of 120 observations: groups of neighbours whose borders shift."""
    grid = spark.range(1, 121).withColumnRenamed("id", "obs")
    grid = grid.withColumn("chain", F.explode(F.array(F.lit(1), F.lit(2))))
    grid = grid.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(10))))
    shift = F.pmod(F.xxhash64("chain", "iteration"), F.lit(7))
    alone = F.pmod(F.xxhash64("chain", "iteration", "obs"), F.lit(9)) == 0
    label = F.when(alone, -F.col("obs")).otherwise(F.floor((F.col("obs") + shift) / 7))
    rows = canonical_labels(grid.withColumn("label", label), ["label"], ["chain", "iteration"])
    return rows.select("chain", "iteration", "obs", "cluster").cache()


def table(df):
    return {(r.chain, r.atom_a, r.atom_b): (r.size_a, r.size_b, round(r.p, 9)) for r in df.collect()}


@pytest.mark.parametrize("min_p", [0.05, 0.3, 0.5, 0.7, 1.0])
@pytest.mark.parametrize("weighted", [False, True])
def test_threshold_is_the_whole_table_filtered(spark, draws, min_p, weighted):
    weights = None
    if weighted:
        weights = draws.select("chain", "iteration").distinct().withColumn("w", F.pow(F.lit(1.4), F.col("iteration")))
    whole = table(similarity.co_occurrence(draws, weights=weights))
    some = similarity.similar_atoms(draws, min_p, weights=weights)
    rows = some.collect()
    assert len(rows) == len({(r.chain, r.atom_a, r.atom_b) for r in rows})
    assert table(some) == {k: v for k, v in whole.items() if v[2] >= min_p}


def test_threshold_of_one_long_list(spark):
    """All atoms share their cluster in nine of ten draws; the rare keys tell which pairs to compare."""
    rows = spark.range(1, 301).withColumnRenamed("id", "obs").withColumn("chain", F.lit(1))
    rows = rows.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(10))))
    rows = rows.withColumn("cluster", F.when(F.col("iteration") < 10, F.lit(1)).otherwise(F.col("obs")))
    assert similarity.similar_atoms(rows, 0.95).count() == 300
    assert similarity.similar_atoms(rows, 0.9).count() == 300 * 301 // 2


def test_threshold_out_of_range(draws):
    for wrong in (0.0, 1.5):
        with pytest.raises(ValueError):
            similarity.similar_atoms(draws, wrong)


def test_nearest_atoms_are_the_first_of_the_sorted_table(draws):
    near = {}
    for (chain, a, b), (_, _, p) in table(similarity.co_occurrence(draws)).items():
        if a != b and p >= 0.2:
            near.setdefault((chain, a), []).append((-p, b))
            near.setdefault((chain, b), []).append((-p, a))
    expected = {(*k, i + 1): (o, -p) for k, v in near.items() for i, (p, o) in enumerate(sorted(v)[:4])}
    got = similarity.nearest_atoms(draws, 4, 0.2).collect()
    assert {(r.chain, r.atom, r["rank"]): (r.other, round(r.p, 9)) for r in got} == expected


def test_passed_sums_follow_distinct_sizes(spark):
    """400 clusters of three sizes: 1,200 rows, each equal to the sum over the older clusters."""
    law = StickArrivalPrior(sticks=(1.3, 0.7), arrivals=(1.5, 2.0))
    sizes = [1 + (i % 3) * 4 for i in range(400)]
    births, obs, rows = [], 0, []
    for n in sizes:
        births.append(obs + 1)
        rows += [(1, obs + j + 1, obs + 1) for j in range(n)]
        obs += n
    frame = spark.createDataFrame(rows, "series int, obs bigint, cluster bigint")
    paths = score._cluster_paths(cluster_sizes(frame, ["series"]), law, ["series"]).cache()
    found = score.passed_sums(paths, ["series"]).collect()
    assert len(found) == 400 * 3
    sticks = {r["rank"]: (r.stick_a, r.stick_b) for r in paths.collect()}

    def ln_beta(a, b):
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    for row in found[::37]:
        cost = sum(
            ln_beta(a, b + row["size"]) - ln_beta(a, b) for rank, (a, b) in sticks.items() if rank <= row["rank"]
        )
        assert row.upto == pytest.approx(cost, abs=1e-8)


def lloyd(rows, centres, steps):
    for step in range(steps + 1):
        near = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        cost = ((rows - centres[near]) ** 2).sum()
        moved = np.array([rows[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        if step == steps or np.allclose(moved, centres, rtol=0.0, atol=1e-12):
            return cost
        centres = moved


def test_elbow_curve_equals_separate_fits(spark):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(c, 0.4, size=(150, 3)) for c in (-4.0, 0.0, 3.0, 9.0)])
    frame = spark.createDataFrame([(row.tolist(),) for row in rows] + [(None,), ([1.0],)], "x array<double>")
    curve = {r.k: r.distortion for r in elbow_curve(frame, 3, range(1, 7), seed=5, tries=4).collect()}
    starts = starting_rows(frame.filter(F.size("x") == 3), 6, 4, 5)
    for k in range(1, 7):
        # Runs that are at rest while others still move stay at rest, so the last step is the same.
        assert curve[k] == pytest.approx(min(lloyd(rows, s[:k], 20) for s in starts), rel=1e-8)
    assert curve[4] < curve[3] / 3 and curve[4] < curve[1] / 50


def test_elbow_curve_of_few_and_no_rows(spark):
    frame = spark.createDataFrame([([1.0],), ([1.0],), ([3.0],)], "x array<double>")
    assert [(r.k, r.distortion) for r in elbow_curve(frame, 1, [1, 2, 3]).collect()] == [
        (1, pytest.approx(8 / 3)), (2, 0.0), (3, 0.0)
    ]
    empty = elbow_curve(frame.filter("false"), 1, [1, 2])
    assert [(r.k, r.distortion) for r in empty.collect()] == [(1, None), (2, None)]


def test_variates_without_a_shape_raise():
    for wrong in (math.nan, 0.0, -1.0, math.inf):
        with pytest.raises(ValueError):
            log_gammas(np.array([1.0, wrong]), np.array([1, 2], dtype=np.uint64))


def test_crossed_paths_are_not_broadcast(spark, draws, monkeypatch):
    """Paths crossed with themselves look as small to Spark as the paths."""
    stored = []

    def keep(df):
        stored.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return df.localCheckpoint()

    monkeypatch.setattr(similarity, "persist_reliably", keep)
    assert similarity.information_losses(draws).count() > 0
    plan = next(plan for columns, plan in stored if "_overlap" in columns)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_folded_draws_give_the_same_summaries(spark, draws):
    folded = similarity.observation_paths(draws)
    truth = spark.range(1, 121).select(F.col("id").alias("obs"), (F.col("id") - (F.col("id") - 1) % 10).alias("cluster"))
    pairs = truth.select(F.col("cluster").alias("obs_a"), F.col("obs").alias("obs_b"))
    summaries = [
        lambda d: similarity.expected_cluster_mates(keep_iterations(d, 3)),
        lambda d: similarity.ari_over_draws(truth, keep_iterations(d, 3)).withColumn("ari", F.round("ari", 9)),
        lambda d: similarity.pair_similarity(keep_iterations(d, 3, 2), pairs),
        lambda d: similarity.atom_members(d),
        lambda d: similarity.similar_atoms(d, 0.4).withColumn("p", F.round("p", 9)),
        lambda d: similarity.binder_losses(d).withColumn("loss", F.round("loss", 9)),
    ]
    for summary in summaries:
        one, two = summary(draws), summary(folded)
        assert sorted(one.columns) == sorted(two.columns)
        want = sorted(tuple(r) for r in one.collect())
        assert want and want == sorted(tuple(r) for r in two.select(*one.columns).collect())


def test_rows_of_folded_draws_are_not_shuffled_per_draw(spark, draws):
    """All observations of a path are one row before any draw is laid out."""
    folded = similarity.observation_paths(draws)
    kinds = folded.select("chain", "path").distinct().count()
    assert similarity.atom_draws(folded).count() == 10 * kinds


def test_prior_scores_compute_the_assignments_once(spark, monkeypatch):
    seen, write = [], score.persist_reliably

    def noted(df):
        seen.append("Range (" in df._jdf.queryExecution().toString())
        return write(df)

    monkeypatch.setattr(score, "persist_reliably", noted)
    rows = spark.range(1, 21).select(F.lit(1).alias("series"), F.col("id").alias("obs"), (F.col("id") - (F.col("id") - 1) % 4).alias("cluster"))
    scores = score.prior_scores(rows, StickArrivalPrior(sticks=(1.0, 1.0), arrivals=(1.0, 1.0)), ["series"])
    assert sum(seen) == 1 and scores.count() > 20
