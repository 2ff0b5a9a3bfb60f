import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firstborn.functions import lbeta, lgamma, log_multivariate_beta, mvn_logpdf, mvt_logpdf
from firstborn.functions.variates import log_beta_variate, log_gamma_variate, row_key
from firstborn.models import CountModel, GaussianModel, GibbsSettings, MetropolisSettings, TopicModel


def test_lgamma_matches_libm(spark):
    xs = [1e-6, 0.01, 0.14, 0.5, 1.0, 1.5, 2.0, 7.9, 8.0, 42.5, 286.0, 1e3, 1e6]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", lgamma(F.col("x")).alias("y")).collect()
    for row in rows:
        assert row.y == pytest.approx(math.lgamma(row.x), rel=2e-14, abs=2e-13)


def test_beta_functions(spark):
    row = spark.range(1).select(
        lbeta(F.lit(2.5), F.lit(0.7)).alias("b"), log_multivariate_beta(F.array(F.lit(2.5), F.lit(0.7))).alias("m")
    ).first()
    want = math.lgamma(2.5) + math.lgamma(0.7) - math.lgamma(3.2)
    assert row.b == pytest.approx(want, abs=1e-12)
    assert row.m == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("dim", [2, 10])
def test_densities_match_numpy(spark, dim):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(dim, dim))
    cov, mean, x = a @ a.T + np.eye(dim), rng.normal(size=dim), rng.normal(size=dim)
    q = float((x - mean) @ np.linalg.inv(cov) @ (x - mean))
    log_det = float(np.linalg.slogdet(cov)[1])
    row = spark.range(1).select(F.array(*[F.lit(float(v)) for v in x]).alias("x")).select(
        mvn_logpdf(F.col("x"), mean, cov).alias("n"), mvt_logpdf(F.col("x"), mean, cov, 4.0).alias("t")
    ).first()
    assert row.n == pytest.approx(-0.5 * (dim * math.log(2 * math.pi) + log_det + q), abs=1e-9)
    want = (
        math.lgamma((4 + dim) / 2) - math.lgamma(2) - dim / 2 * math.log(4 * math.pi) - log_det / 2
        - (4 + dim) / 2 * math.log(1 + q / 4)
    )
    assert row.t == pytest.approx(want, abs=1e-9)


def test_variates_have_their_moments_and_ignore_partitioning(spark):
    base = spark.range(40000)

    def draw(parts):
        df = base.repartition(parts)
        return df.select(
            "id",
            log_gamma_variate(F.lit(0.4), row_key(7, F.col("id"))).alias("g"),
            log_beta_variate(F.lit(2.0), F.lit(0.5), row_key(8, F.col("id"))).alias("b"),
        ).select("id", "g", "b.log_in", "b.log_out").orderBy("id").toPandas()

    one, two = draw(2), draw(7)
    assert one.equals(two)
    g, b = np.exp(one.g), np.exp(one.log_in)
    assert g.mean() == pytest.approx(0.4, abs=0.02) and g.var() == pytest.approx(0.4, abs=0.04)
    assert b.mean() == pytest.approx(0.8, abs=0.01)
    assert np.allclose(b + np.exp(one.log_out), 1.0)


@pytest.mark.parametrize(
    "make",
    [
        lambda: GaussianModel(np.eye(2), [0.0, 0.0], np.eye(3)),
        lambda: GaussianModel(np.eye(2), [0.0], np.eye(2)),
        lambda: CountModel(1, 1.0),
        lambda: CountModel(2, {"a": 1.0, "b": 0.0}),
        lambda: CountModel(2, 1.0, 0),
        lambda: TopicModel(num_topics=1),
        lambda: GibbsSettings(iterations=0),
        lambda: GibbsSettings(burn_in=-1),
        lambda: GibbsSettings(starts=("somewhere",)),
        lambda: MetropolisSettings(radius=0),
    ],
)
def test_settings_are_validated(make):
    with pytest.raises(ValueError):
        make()
