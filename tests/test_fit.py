"""The samplers leave the exact posterior in place.

Thousands of copies of one short series start from exact posterior draws; after
a few sweeps their clusterings must still follow the exact posterior.
"""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firstborn.models import CountModel, DirichletProcessPrior, GaussianModel, GibbsSettings, MetropolisSettings, StickArrivalPrior, TopicModel
from firstborn.operators import exact, likelihood as lk
from firstborn.operators.stats import whiten
from firstborn.plans.fit import fit
from firstborn.sources.tables import words

COPIES = 4000
STICKS = StickArrivalPrior(sticks=(1.3, 0.7), arrivals=(1.5, 2.0))
PROCESS = DirichletProcessPrior(1.5)
NORMAL = GaussianModel([[0.5]], [0.0], [[1.0]])
COUNTS = CountModel(4, 0.7)
XS = [0.3, -0.9, 1.1, -0.4]
TERMS = [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 2), (3, "b", 3), (4, "a", 1), (4, "c", 1)]


@pytest.mark.parametrize(
    "model,law,settings",
    [
        (NORMAL, STICKS, GibbsSettings(iterations=1, burn_in=5, seed=3)),
        (COUNTS, PROCESS, MetropolisSettings(iterations=1, burn_in=5, radius=1, seed=4)),
    ],
    ids=["gibbs-normal-sticks", "metropolis-counts-process"],
)
def test_exact_posterior_is_invariant(spark, model, law, settings):
    points = spark.createDataFrame([(i + 1, [x]) for i, x in enumerate(XS)], "obs bigint, x array<double>")
    terms = spark.createDataFrame(TERMS, "obs bigint, term string, cnt bigint")
    series = spark.createDataFrame([(0, 4)], "series bigint, n bigint")
    rows = exact.partition_rows(exact.all_partitions(series, ["series"], 4), ["series"])
    if model is NORMAL:
        rows = rows.join(whiten(points, model), "obs")
    scored = lk.joint_score(rows, model, law, ["series", "code"], terms, ["obs"], levels=1)
    probability = {
        tuple(r.labels): r.probability
        for r in exact.exact_posterior(scored, ["series"]).withColumn("labels", exact.code_labels()).collect()
    }
    keys = list(probability)
    p = np.array([probability[k] for k in keys])
    picks = np.random.default_rng(1).choice(len(keys), COPIES, p=p / p.sum())
    start = pd.DataFrame(
        [(1, s, i + 1, keys[z][i]) for s, z in enumerate(picks) for i in range(4)],
        columns=["chain", "series", "obs", "cluster"],
    )
    start = spark.createDataFrame(start, "chain int, series bigint, obs bigint, cluster bigint")
    copies = spark.range(COPIES).withColumnRenamed("id", "series")
    many = copies.crossJoin(points)
    many_terms = None if model is NORMAL else copies.crossJoin(terms)
    out = fit(many, model, law, settings, ["series"], many_terms, width=3, start=start)
    labels = F.transform(F.sort_array(F.collect_list(F.struct("obs", "cluster"))), lambda v: v["cluster"])
    rows = out.draws.groupBy("series").agg(labels.alias("z")).groupBy("z").count().collect()
    got = {tuple(r.z): r["count"] / COPIES for r in rows}
    begun = np.bincount(picks, minlength=len(keys)) / COPIES
    moved = sum(abs(begun[i] - got.get(k, 0)) for i, k in enumerate(keys))
    distance = 0.5 * sum(abs(probability[k] - got.get(k, 0)) for k in keys)
    assert set(got) <= set(keys)
    assert moved > 0
    assert distance < 0.045


def test_resampled_topics_write_one_row_per_term_not_one_per_topic(spark, monkeypatch):
    from firstborn.plans import topics

    written = []

    def write(df):
        written.append(df.count())
        return df.localCheckpoint()

    monkeypatch.setattr(topics, "persist_reliably", write)
    rows = spark.createDataFrame([(1, 1, 1, "a b b c"), (1, 2, 1, "c d a"), (1, 3, 3, None)], "series int, obs bigint, cluster bigint, text string")
    tokens = words(rows, ["series", "obs"])
    model = TopicModel(8, 20)
    drawn = topics.resample_topics(topics.random_topics(tokens, ["series"], model, 1), rows, ["series"], model, 1, 2)
    kept = sorted(tuple(r) for r in drawn.select("obs", "place", "term").collect())
    assert kept == sorted(tuple(r) for r in tokens.select("obs", "place", "term").collect())
    assert drawn.filter(~F.col("topic").between(0, 7)).count() == 0
    assert max(written) == 4  # four terms; eight topics ride along in arrays


def test_few_terms_ride_along_and_give_the_draws_of_the_joins(spark, monkeypatch):
    from firstborn.functions.special import log_beta_gain
    from firstborn.plans import fit as plan

    rows = spark.createDataFrame([(s, o) for s in (1, 2) for o in range(1, 9)], "series int, obs bigint")
    counts = [(s, o, t, 1 + (o * s + ord(t)) % 5) for s in (1, 2) for o in range(1, 9) for t in "abc" if (o + ord(t)) % 3]
    terms = spark.createDataFrame(counts, "series int, obs bigint, term string, cnt bigint")
    settings = GibbsSettings(iterations=3, seed=7)
    joined = []
    whole = plan._Sampler.term_parameters
    monkeypatch.setattr(plan._Sampler, "term_parameters", lambda *args: joined.append(1) or whole(*args))

    def run():
        out = fit(rows, COUNTS, PROCESS, settings, ["series"], terms)
        draws = sorted(tuple(r) for r in out.draws.select("series", "iteration", "obs", "cluster").collect())
        scores = [r.log_likelihood for r in out.trace.orderBy("series", "iteration").collect()]
        return draws, scores

    draws, scores = run()
    assert not joined
    monkeypatch.setattr(plan, "NARROW", 0)
    again, others = run()
    assert joined
    assert draws == again
    assert scores == pytest.approx(others)
    gain = spark.sql("SELECT array(0.5D, 2.0D, 1.5D) AS a, array(3.0D, 0.0D) AS c").select(log_beta_gain("a", "c")).first()[0]
    want = [math.lgamma(v) for v in (3.5, 2.0, 1.5, 4.0, 0.5, 2.0, 1.5, 7.0)]
    assert gain == pytest.approx(sum(want[:3]) + want[3] - sum(want[4:7]) - want[7])


def test_members_are_drawn_without_sorting_all_pairs(spark, monkeypatch):
    from firstborn.plans import fit as plan

    monkeypatch.setattr(plan, "persist_reliably", lambda df: df)
    state = spark.createDataFrame([(1, 1, o, min(o, 3), [float(o)]) for o in range(1, 9)], "chain int, series int, obs bigint, cluster bigint, y array<double>")
    params = spark.createDataFrame(
        [(1, 1, c, 8, 1, -1.0, -0.5 * c, [float(c)]) for c in range(1, 4)],
        "chain int, series int, cluster bigint, n bigint, n_k bigint, log_psi double, path double, theta array<double>",
    )
    sampler = plan._Sampler(state.select("series", "obs", "y"), NORMAL, PROCESS, GibbsSettings(1), ["series"], None, 64, "")
    moved = sampler.gibbs_members(state, params, None, 2)
    assert "SortAggregate" not in moved._jdf.queryExecution().executedPlan().toString()
    rows = {r.obs: r for r in moved.collect()}
    assert {o: r.y for o, r in rows.items()} == {o: [float(o)] for o in range(1, 9)}
    assert all(r.cluster == o if o <= 3 else r.cluster in (1, 2, 3) for o, r in rows.items())


def test_topic_counts_ride_along(spark):
    from firstborn.plans import fit as plan

    rows = spark.createDataFrame([(1, 1, "a b b c"), (1, 2, "c d a"), (1, 3, None)], "series int, obs bigint, text string")
    sampler = plan._Sampler(
        rows, TopicModel(3, 5), STICKS, GibbsSettings(1, starts=("all same cluster",)), ["series"], words(rows, ["series", "obs"]), 64, "", vocabulary=[0, 1, 2]
    )
    state = {r.obs: r.c for r in sampler.start().collect()}
    want = {o: [0.0] * 3 for o in (1, 2, 3)}
    for r in sampler.tokens.collect():
        want[r.obs][r.topic] += 1
    assert state == want
    assert [sum(want[o]) for o in (1, 2, 3)] == [4, 3, 0]
