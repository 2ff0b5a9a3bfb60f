import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from firstborn.operators.joins import skew_join
from firstborn.operators.order import number_rows, running_sums
from firstborn.operators.labels import canonical_labels


def hot_rows(spark, n=3000):
    """One series holds most rows and one time value repeats a lot."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"series": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 40, n)), "t": rng.integers(0, 5, n)})
    pdf["id"] = rng.permutation(n)
    return pdf, spark.createDataFrame(pdf)


def test_positions_are_dense_for_any_partitioning(spark):
    pdf, df = hot_rows(spark)
    want = pdf.sort_values(["t", "id"]).reset_index(drop=True)
    for parts in (1, 5, 16):
        got = number_rows(df.repartition(7), ["t", "id"], partitions=parts).orderBy("obs").toPandas()
        assert got.obs.tolist() == list(range(1, len(pdf) + 1))
        assert got.id.tolist() == want.id.tolist()


def test_positions_within_a_hot_series(spark):
    pdf, df = hot_rows(spark)
    got = number_rows(df, ["t", "id"], ["series"], partitions=6).toPandas().sort_values(["series", "obs"])
    want = pdf.sort_values(["series", "t", "id"])
    assert got.id.tolist() == want.id.tolist()
    assert got.obs.tolist() == (want.groupby("series").cumcount() + 1).tolist()


def test_running_sums_over_blocks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.repeat([1, 2], 500), "p": np.tile(np.arange(1, 501), 2), "v": rng.integers(0, 9, 1000)})
    df = spark.createDataFrame(pdf)
    for levels in (1, 2, 3):
        for inclusive in (True, False):
            got = running_sums(df, {"s": "v"}, "p", ["k"], inclusive, block=7, levels=levels).toPandas()
            got = got.sort_values(["k", "p"])
            want = pdf.groupby("k").v.cumsum() - (0 if inclusive else pdf.v)
            assert got.s.tolist() == want.tolist()


def test_salted_join_equals_plain_join(spark):
    _, df = hot_rows(spark)
    groups = df.groupBy("series").agg(F.count("*").alias("size"), F.max("t").alias("top"))
    plain = df.join(groups, "series").select("id", "size", "top").toPandas().sort_values("id")
    salted = skew_join(df, groups, ["series"], "size", "id", rows_per_salt=50)
    salted = salted.select("id", "size", "top").toPandas().sort_values("id")
    assert salted.values.tolist() == plain.values.tolist()


def test_canonical_labels_do_not_depend_on_names(spark):
    pdf = pd.DataFrame({"obs": range(1, 9), "z": ["b", "a", "b", "c", "a", "b", "c", "d"]})
    got = canonical_labels(spark.createDataFrame(pdf).repartition(3), ["z"]).orderBy("obs").toPandas()
    assert got.cluster.tolist() == [1, 2, 1, 4, 2, 1, 4, 8]
