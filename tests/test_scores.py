"""Priors sum to one, leave-one-out scores are joint ratios, marginals obey the chain rule."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firstborn.models import CountModel, DirichletProcessPrior, GaussianModel, StickArrivalPrior
from firstborn.operators import draws as draws_module, exact, likelihood as lk, prior, score, similarity
from firstborn.operators.stats import whiten

STICKS = StickArrivalPrior(sticks=(1.3, 0.7), arrivals=(1.5, 2.0))
PROCESS = DirichletProcessPrior(1.7)


def partitions(spark, n):
    series = spark.createDataFrame([(0, n)], "series bigint, n bigint")
    return exact.all_partitions(series, ["series"], n)


@pytest.mark.parametrize("n,bell", [(4, 15), (5, 52), (6, 203)])
@pytest.mark.parametrize("law", [STICKS, PROCESS])
def test_partition_priors_sum_to_one(spark, n, bell, law):
    parts = partitions(spark, n)
    rows = exact.partition_rows(parts, ["series"])
    sizes = rows.groupBy("code", "cluster").agg(F.count("*").alias("n_k"))
    scores = [r.assignment_score for r in prior.assignment_score(sizes, law, ["code"]).collect()]
    assert len(scores) == bell
    assert sum(math.exp(s) for s in scores) == pytest.approx(1.0, abs=1e-10)


@pytest.mark.parametrize("law", [STICKS, PROCESS])
def test_leave_one_out_equals_joint_ratios(spark, law):
    """For every partition of five points, the scores of one point's options differ as the joints do."""
    model = GaussianModel([[0.5]], [0.2], [[1.5]])
    xs = [0.3, -0.9, 1.1, -0.4, 2.0]
    points = spark.createDataFrame([(i + 1, [x]) for i, x in enumerate(xs)], "obs bigint, x array<double>")
    rows = exact.partition_rows(partitions(spark, 5), ["series"]).withColumn("key", F.concat_ws("-", F.transform(exact.code_labels(), lambda v: v.cast("string"))))
    rows = rows.join(whiten(points, model), "obs").select("key", "obs", "cluster", "y")
    joint = {
        tuple(map(int, r.key.split("-"))): r.joint_score
        for r in lk.joint_score(rows, model, law, ["key"], levels=1).collect()
    }
    scored = score.leave_one_out(rows, model, law, ["key"]).toPandas()
    checked = 0
    for (key, obs), options in scored.groupby(["key", "obs"]):
        base = list(map(int, key.split("-")))
        gaps = []
        for _, option in options.iterrows():
            moved = base.copy()
            moved[obs - 1] = "new" if option.is_new else (
                moved[obs - 1] if option.candidate == base[obs - 1] else option.candidate
            )
            named = {}
            for i, z in enumerate(moved):
                named.setdefault(z, i + 1)
            canonical = tuple(named[z] for z in moved)
            gaps.append(option.score - joint[canonical])
        checked += len(gaps)
        assert np.ptp(gaps) < 1e-8
    assert checked > 500


def test_gaussian_marginal_is_a_chain_of_predictives(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 3))
    model = GaussianModel(a @ a.T + np.eye(3), [0.5, -1.0, 2.0], np.diag([1.0, 2.0, 0.5]) + 0.1)
    x = rng.normal(size=(6, 3))
    points = spark.createDataFrame([(i + 1, 1, v.tolist()) for i, v in enumerate(x)], "obs bigint, cluster bigint, x array<double>")
    white = whiten(points, model)
    stats = lk.gaussian_stats(white, model)
    whole = stats.select(lk.gaussian_marginal(model).alias("m")).first().m
    data, p0, m0 = model.data_covariance, model.prior_covariance, model.prior_mean
    total = 0.0
    for i in range(6):
        precision = np.linalg.inv(p0) + i * np.linalg.inv(data)
        cov = np.linalg.inv(precision)
        mean = cov @ (np.linalg.inv(p0) @ m0 + np.linalg.inv(data) @ x[:i].sum(axis=0))
        spread = data + cov
        gap = x[i] - mean
        total += -0.5 * (3 * math.log(2 * math.pi) + np.linalg.slogdet(spread)[1] + gap @ np.linalg.inv(spread) @ gap)
    assert whole == pytest.approx(total, abs=1e-9)
    back = lk.gaussian_posterior(stats, model).first()
    precision = np.linalg.inv(p0) + 6 * np.linalg.inv(data)
    assert np.allclose(np.array(back.post_cov).reshape(3, 3), np.linalg.inv(precision))
    want = np.linalg.inv(precision) @ (np.linalg.inv(p0) @ m0 + np.linalg.inv(data) @ x.sum(axis=0))
    assert np.allclose(back.post_mean, want)


def test_point_estimates_match_pair_formulas(spark):
    rng = np.random.default_rng(5)
    n, t = 12, 6
    labels = rng.integers(0, 4, (t, n))
    pdf = pd.DataFrame(
        [(1, i + 1, j + 1, int(np.argmax(labels[i] == labels[i, j])) + 1) for i in range(t) for j in range(n)],
        columns=["chain", "iteration", "obs", "cluster"],
    )
    draws = spark.createDataFrame(pdf)
    same = np.array([[[a == b for b in row] for a in row] for row in labels], dtype=float)
    p = same.mean(axis=0)
    binder = {r.iteration: r.loss for r in similarity.binder_losses(draws).collect()}
    info = {r.iteration: r.loss for r in similarity.information_losses(draws).collect()}
    for i in range(t):
        pairs = [(a, b) for a, b in itertools.combinations(range(n), 2)]
        want = sum(np.abs(same[i, a, b] - same[:, a, b]).mean() for a, b in pairs)
        assert binder[i + 1] == pytest.approx(want, abs=1e-9)
        want = np.mean(
            [math.log2(same[i, a].sum()) + math.log2(p[a].sum()) - 2 * math.log2((same[i, a] * p[a]).sum()) for a in range(n)]
        )
        assert info[i + 1] == pytest.approx(want, abs=1e-9)
    atoms = {r.obs: r.atom for r in similarity.atom_members(draws).collect()}
    held = {(r.atom_a, r.atom_b): r.p for r in similarity.co_occurrence(draws).collect()}
    for a in range(n):
        for b in range(n):
            key = tuple(sorted((atoms[a + 1], atoms[b + 1])))
            assert held.get(key, 0.0) == pytest.approx(p[a, b])


def test_counts_predictive_is_a_marginal_ratio(spark):
    model = CountModel(4, 0.7)
    terms = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 2)], "obs bigint, term string, cnt bigint")
    both = terms.withColumn("cluster", F.lit(1)).groupBy("cluster", "term").agg(F.sum("cnt").alias("cnt"))
    first = terms.filter("obs = 1").select(F.lit(1).alias("cluster"), "term", "cnt")
    pairs = spark.createDataFrame([(2, 2, 1)], "obs bigint, cluster int, candidate int")
    got = lk.dirichlet_predictive(terms, first, pairs, model).first().log_data
    ratio = lk.dirichlet_marginal(both, model).first().log_marginal - lk.dirichlet_marginal(first, model).first().log_marginal
    coefficient = math.lgamma(4) - math.lgamma(2) - math.lgamma(3)
    assert got == pytest.approx(ratio + coefficient, abs=1e-10)


@pytest.mark.parametrize("name", ["m20_exact_posterior", "m21_validation_table"])
def test_series_too_long_to_enumerate_have_candidates(spark, tmp_path, name):
    """Series of 2, 13 and 40 turns against the SQL; the long ones are scored over their own draws."""
    import __spark_entry__ as contract
    import check

    turns = [
        (series, turn, ("user", "assistant", "tool")[(turn * turn + series) % 3], "x" * (3 + turn * series % 50))
        for series, n in ((1, 2), (2, 13), (3, 40))
        for turn in range(n)
    ]
    pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet")
    assert check.compare(spark, check.connect(str(tmp_path)), name, str(tmp_path)).startswith("ok")
    got = contract.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r.labels for r in got if r.series == 1) == ["1-1", "1-2"]
    for series in (2, 3):
        mine = [r for r in got if r.series == series]
        assert all(r.labels is None and r.candidates == len(mine) for r in mine) and len(mine) > 10
        assert 0 in {r.candidate for r in mine} and sum(r.probability for r in mine) == pytest.approx(1.0, abs=1e-5)


def test_candidates_are_the_distinct_draws(spark):
    drawn = [(s, i, o + 1, c) for s in (1, 2) for i, z in enumerate([[1, 1, 3], [1, 2, 2], [1, 1, 3], [1, 2, 3]], 1) for o, c in enumerate(z)]
    draws = spark.createDataFrame(drawn, "series int, iteration int, obs bigint, cluster bigint")
    given = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2)], "series int, obs bigint, cluster bigint")
    got = exact.candidate_clusterings(draws, ["series"], given)
    labels = {}
    for r in sorted(got.collect(), key=lambda r: r.obs):
        labels.setdefault((r.series, r.candidate), []).append(r.cluster)
    assert labels == {
        (1, 0): [1, 2, 2], (1, 1): [1, 1, 3], (1, 4): [1, 2, 3], (2, 1): [1, 1, 3], (2, 2): [1, 2, 2], (2, 4): [1, 2, 3],
    }


@pytest.mark.parametrize("dim", [1, 2])
def test_partitions_are_scored_on_their_own_rows(spark, dim):
    """The joint score and fingerprint of every partition, with nothing broadcast or shuffled after it is made."""
    model = GaussianModel(0.5 * np.eye(dim), [0.2] * dim, 1.5 * np.eye(dim))
    points = [(s, i + 1, [None if (s, i) == (2, 1) else 0.7 * i - s + j for j in range(dim)]) for s, n in ((1, 5), (2, 3), (3, 9)) for i in range(n)]
    rows = whiten(spark.createDataFrame(points, "series bigint, obs bigint, x array<double>"), model)
    scored = exact.enumerated_scores(exact.short_series(rows, ["series"], 5), model, STICKS, ["series"], 9, limit=5)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate")] and "Aggregate" not in plan[: plan.index("Generate")]
    got = {(r.series, r.code): r for r in scored.withColumns(exact.code_signatures()).collect()}
    assert len(got) == 52 + 5
    series = rows.groupBy("series").agg(F.count("*").alias("n"))
    folded = exact.partition_rows(exact.all_partitions(series, ["series"], 9, limit=5), ["series"])
    joint = lk.joint_score(folded.join(rows, ["series", "obs"]), model, STICKS, ["series", "code"], levels=1).collect()
    assert {(r.series, r.code) for r in joint} == set(got)
    assert all(got[r.series, r.code].joint_score == pytest.approx(r.joint_score, abs=1e-9) for r in joint)
    prints = draws_module.signatures(folded, ["series", "code"]).collect()
    assert all((got[r.series, r.code].sig_a, got[r.series, r.code].sig_b) == (r.sig_a, r.sig_b) for r in prints)
