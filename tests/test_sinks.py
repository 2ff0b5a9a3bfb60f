import math
import threading

import pytest
from pyspark.sql import functions as F

from firstborn.models import CountModel, GaussianModel, GibbsSettings, StickArrivalPrior, TopicModel
from firstborn.operators.draws import batch_standard_errors
from firstborn.operators.exact import all_partitions, too_long
from firstborn.operators.labels import one_hot_dense
from firstborn.plans.fit import fit, last_state
from firstborn.session import persist_reliably, table_scope
from firstborn.sources.tables import read_clustering_csv, read_draws, write_clustering_csv, write_iterations


def test_writing_an_iteration_again_replaces_it(spark, tmp_path):
    rows = spark.range(1, 5).select(F.col("id").alias("obs"), F.lit(1).cast("bigint").alias("cluster"), F.lit(1).alias("chain"))
    for iteration in (3, 4, 4):
        write_iterations(rows.withColumn("iteration", F.lit(iteration)), str(tmp_path))
    got = read_draws(spark, str(tmp_path)).groupBy("iteration").count().collect()
    assert {r.iteration: r["count"] for r in got} == {3: 4, 4: 4}


def test_clustering_csv_keeps_empty_and_null_texts(spark, tmp_path):
    texts = ["", None, "a\nb", 'say "x"', " lead", "NULL", "a,b"]
    rows = [(str(i), t, i) for i, t in enumerate(texts)]
    write_clustering_csv(spark.createDataFrame(rows, "timestamp string, tweet string, cluster bigint"), str(tmp_path))
    assert sorted(map(tuple, read_clustering_csv(spark, str(tmp_path)).collect())) == rows


def test_one_hot_covers_every_cluster(spark):
    rows = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 3, 1), ("s", 4, 4)], "series string, obs bigint, cluster bigint")
    got = sorted(map(tuple, one_hot_dense(rows, 3, ["series"]).collect()))
    assert got == [("s", 1, 1, 0, 0), ("s", 2, 0, 1, 0), ("s", 3, 1, 0, 0), ("s", 4, 0, 0, 1)]
    with pytest.raises(Exception, match="more than 2 clusters"):
        one_hot_dense(rows, 2, ["series"]).collect()


def test_batches_cover_the_whole_chain(spark):
    hits = {3, 4, 11, 18, 19}
    sigs = spark.createDataFrame([(i, int(i in hits), 0) for i in range(1, 20)], "iteration int, sig_a int, sig_b int").withColumn("chain", F.lit(1))
    targets = spark.createDataFrame([(1, 1, 0)], "chain int, sig_a int, sig_b int")
    se = batch_standard_errors(sigs, targets, ["chain"], 19).first().se
    parts = [[i for i in range(1, 20) if (i - 1) * 4 // 19 == b] for b in range(4)]
    assert sorted(i for p in parts for i in p) == list(range(1, 20))
    p = [sum(i in hits for i in part) / len(part) for part in parts]
    spread = sum(x * x for x in p) - sum(p) ** 2 / 4
    assert math.isclose(se, math.sqrt(19 / 4 / 3 * spread) / math.sqrt(19))


def test_scopes_of_other_threads_are_left_alone(spark):
    seen = {}

    def other():
        with table_scope() as mine:
            persist_reliably(spark.range(3)).count()
            seen["other"] = list(mine)

    with table_scope() as outer:
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert not outer
        with table_scope() as inner:
            persist_reliably(spark.range(3))
            assert len(inner) == 1 and not outer
        assert outer == inner
    assert len(seen["other"]) == 1


def test_unknown_terms_and_bad_settings_are_refused(spark):
    terms = spark.createDataFrame([("s", 1, "A", 1), ("s", 1, "B", 1)], "series string, obs bigint, term string, cnt bigint")
    with pytest.raises(Exception, match="no Dirichlet scale"):
        terms.select(CountModel(2, {"A": 1.0, "C": 1.0}).scale_of(F.col("term"))).collect()
    rows = terms.select("series", "obs").distinct()
    with pytest.raises(ValueError, match="more than the model's 2 terms"):
        fit(rows, TopicModel(2, 2), StickArrivalPrior(), GibbsSettings(1), ["series"], terms.withColumn("place", F.lit(1)).unionByName(terms.withColumn("place", F.lit(1)).withColumn("term", F.lit("D"))))
    with pytest.raises(ValueError, match="bad_value"):
        bad = spark.createDataFrame([(1, [float("nan")]), (2, [1.0])], "obs bigint, x array<double>")
        fit(bad, GaussianModel([[1.0]], [0.0], [[1.0]]), StickArrivalPrior(), GibbsSettings(1))
    for make in (
        lambda: GaussianModel([[1.0, 2.0], [2.0, 1.0]], [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]),
        lambda: GaussianModel([[1.0]], [float("nan")], [[1.0]]),
        lambda: CountModel(1),
        lambda: CountModel(2, {"A": 1.0}),
        lambda: StickArrivalPrior(sticks=(0.0, 1.0)),
        lambda: GibbsSettings(0),
    ):
        with pytest.raises(ValueError):
            make()


def test_a_fit_can_go_on_from_its_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 2 * 50)]) for i in range(1, 13)], "obs bigint, x array<double>")
    model = GaussianModel([[1.0]], [0.0], [[900.0]])
    out = fit(rows, model, StickArrivalPrior(), GibbsSettings(2, starts=("all same cluster",)), path=str(tmp_path))
    last = last_state(spark, out.path)
    want = out.draws.filter("iteration = 2").select("chain", "obs", "cluster")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    more = fit(rows, model, StickArrivalPrior(), GibbsSettings(1, starts=("random",)), start=last)
    assert sorted(map(tuple, more.draws.select("chain", "obs", "cluster").collect())) == sorted(map(tuple, want.collect()))


def test_a_long_series_is_listed_and_the_others_enumerated(spark):
    series = spark.createDataFrame([("a", 3), ("b", 16), ("c", 1)], "series string, n bigint")
    parts = all_partitions(series, ["series"], 16, limit=4)
    assert {r.series: r["count"] for r in parts.groupBy("series").count().collect()} == {"a": 5, "c": 1}
    assert [tuple(r) for r in too_long(series, ["series"], 4).collect()] == [("b", 16)]
    with pytest.raises(ValueError, match="codes hold"):
        all_partitions(series, ["series"], 16, limit=16)
