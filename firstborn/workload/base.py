"""Inputs of the registered queries, in Spark and as SQL text for the comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import hash52
from ..models import CountModel, DirichletProcessPrior, GaussianModel, StickArrivalPrior, TopicModel
from ..operators.draws import unfold
from ..operators.labels import canonical_labels
from ..operators.stats import whiten
from ..session import persist_reliably
from ..sources.tables import assigned_observations, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CHAINS = 2
DRAWS = 20
TOPICS = 4

STICKS = StickArrivalPrior(sticks=(1.3, 0.7), arrivals=(1.5, 4.0))
DP = DirichletProcessPrior(alpha=2.0)
VALUES = GaussianModel([[400.0]], [50.0], [[2500.0]])
LENGTHS = GaussianModel([[0.25]], [5.0], [[1.0]])
FLAGS = CountModel(3, {"A": 0.5, "N": 1.0, "R": 1.5})
TOPIC_MODEL = TopicModel(TOPICS, 1000, 0.3, 0.1)


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL it must agree with where SQL can say it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(value: Column | str, digits: int = 6) -> Column:
    return F.round(value, digits)


# --- inputs -----------------------------------------------------------------


def events(spark, sf) -> DataFrame:
    """All events as one series; a cluster is a user, born at the user's first event."""
    raw = table(spark, sf, "events").select("ts", "event_id", "user_id", "event_type", "value")
    return assigned_observations(raw, ["ts", "event_id"], ["user_id"])


def users(spark, sf) -> DataFrame:
    """One series per user; a cluster is an event type within the series."""
    raw = table(spark, sf, "events").select(
        F.col("user_id").alias("series"), "ts", "event_id", "event_type", "value"
    )
    return assigned_observations(raw, ["ts", "event_id"], ["event_type"], ["series"])


def white_users(spark, sf) -> DataFrame:
    return whiten(users(spark, sf).withColumn("x", F.array("value")), VALUES)


def customers(spark, sf) -> DataFrame:
    """One series of orders per customer; a cluster is an order priority."""
    raw = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("series"), "o_orderdate", "o_orderkey", "o_orderpriority"
    )
    return assigned_observations(raw, ["o_orderdate", "o_orderkey"], ["o_orderpriority"], ["series"])


def customer_flags(spark, sf, orders: DataFrame) -> DataFrame:
    """Line items of each order counted by return flag, before they meet the orders."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("term"))
        .agg(F.count("*").alias("cnt"))
    )
    return lines.join(orders.select("series", "obs", "o_orderkey"), "o_orderkey").select(
        "series", "obs", "term", "cnt"
    )


def turns(spark, sf) -> DataFrame:
    """One series per conversation; a cluster is a role."""
    raw = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("series"), "turn", "role", "text"
    )
    return assigned_observations(raw, ["turn"], ["role"], ["series"])


def turn_lengths(turn_rows: DataFrame) -> DataFrame:
    x = F.array(F.ln(F.length("text").cast("double") + 1.0)).alias("x")
    return whiten(turn_rows.select("series", "obs", "cluster", x), LENGTHS)


def turn_tokens(turn_rows: DataFrame) -> DataFrame:
    """Every word of every turn with a topic derived from its place."""
    key = F.concat_ws(":", F.col("series"), F.col("obs"), F.col("place"))
    return (
        words(turn_rows, ["series", "obs"])
        .withColumn("topic", (hash52(key) % TOPICS).cast("int"))
        .select("series", "obs", "place", "term", "topic")
    )


def with_vocabulary(model: TopicModel, tokens: DataFrame) -> TopicModel:
    """The model with as many words as the tokens have."""
    return replace(model, num_words=max(2, tokens.select("term").distinct().count()))


def paths(spark, sf, keep=("obs",)) -> DataFrame:
    """Draws over all events, folded: neighbouring users merge, some stand alone in a draw."""
    base = events(spark, sf)
    births = base.groupBy("user_id").agg(F.min("obs").alias("obs"))
    grid = births.withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(CHAINS)))).withColumn(
        "iteration", F.explode(F.sequence(F.lit(1), F.lit(DRAWS)))
    )
    alone = hash52(F.concat_ws(":", "user_id", "chain", "iteration")) % 10 == 0
    shift = hash52(F.concat_ws(":", "chain", "iteration")) % 5
    label = F.when(alone, -F.col("user_id") - 1).otherwise(
        F.floor((F.col("user_id") + shift) / F.lit(5))
    )
    by_user = canonical_labels(grid.withColumn("label", label), ["label"], ["chain", "iteration"])
    path = F.sort_array(F.collect_list(F.struct("iteration", "cluster"))).alias("path")
    # One row per user and chain, read by several plans.
    folded = persist_reliably(by_user.groupBy("user_id", "chain").agg(path))
    return base.select("user_id", *keep).join(folded, "user_id").select("chain", *keep, "path")


def draws(spark, sf, keep=("obs",)) -> DataFrame:
    """The same draws, one row per event and draw."""
    return unfold(paths(spark, sf, keep)).select("chain", "iteration", *keep, "cluster")


def turn_draws(turn_rows: DataFrame) -> DataFrame:
    """Draws over the turns of each conversation."""
    rows = turn_rows.select("series", "obs").withColumn(
        "iteration", F.explode(F.sequence(F.lit(1), F.lit(DRAWS)))
    )
    label = hash52(F.concat_ws(":", "series", "obs", "iteration")) % 3
    return canonical_labels(
        rows.withColumn("label", label), ["label"], ["series", "iteration"]
    ).select("series", "iteration", "obs", "cluster")


# --- the same inputs as SQL -------------------------------------------------


def h52(key: str) -> str:
    return f"(('0x' || substr(md5({key}),1,13))::BIGINT)"


def lb(a: str, b: str) -> str:
    return f"(lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))"


EV = """ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS obs, user_id, event_type, value FROM events)"""
EA = EV + """,
ea AS (SELECT obs, min(obs) OVER (PARTITION BY user_id) AS cluster, user_id, event_type, value FROM ev)"""
CW = EA + """,
cs AS (SELECT cluster, count(*) AS n_k FROM ea GROUP BY 1),
cw AS (SELECT cluster, n_k, (coalesce(sum(n_k) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  - (cluster - 1))::BIGINT AS comp FROM cs)"""
UA = """us AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS obs, event_type, value FROM events),
ua AS (SELECT series, obs, min(obs) OVER (PARTITION BY series, event_type) AS cluster, event_type, value FROM us)"""
UW = UA + """,
cs AS (SELECT series, cluster, count(*) AS n_k FROM ua GROUP BY ALL),
cw AS (SELECT series, cluster, n_k, (coalesce(sum(n_k) OVER (PARTITION BY series ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  - (cluster - 1))::BIGINT AS comp FROM cs)"""
CA = """co AS (SELECT o_custkey AS series, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS obs, o_orderpriority AS p FROM orders),
ca AS (SELECT series, o_orderkey, obs, min(obs) OVER (PARTITION BY series, p) AS cluster FROM co),
ct AS (SELECT series, obs, l_returnflag AS term, count(*) AS cnt FROM lineitem JOIN ca ON l_orderkey = o_orderkey GROUP BY ALL),
al AS (SELECT * FROM (VALUES ('A', 0.5::DOUBLE), ('N', 1.0::DOUBLE), ('R', 1.5::DOUBLE)) v(term, a))"""
TU = """tu AS (SELECT conv_id AS series, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS obs, role, text FROM conversations),
ta AS (SELECT series, obs, min(obs) OVER (PARTITION BY series, role) AS cluster, text, ln(length(text) + 1.0::DOUBLE) AS x FROM tu)"""
TK = TU + """,
w0 AS (SELECT series, obs, unnest(string_split(lower(text), ' ')) AS term, generate_subscripts(string_split(lower(text), ' '), 1) - 1 AS place FROM ta),
tk AS (SELECT series, obs, place, term, (""" + h52("series || ':' || obs || ':' || place") + f""" % {TOPICS})::INTEGER AS topic FROM w0 WHERE term <> '')"""
DR = EV + f""",
ub AS (SELECT user_id, min(obs) AS birth FROM ev GROUP BY 1),
ul AS (SELECT user_id, birth, chain::INTEGER AS chain, iteration::INTEGER AS iteration,
  CASE WHEN {h52("user_id || ':' || chain || ':' || iteration")} % 10 = 0 THEN -user_id - 1
  ELSE (user_id + {h52("chain || ':' || iteration")} % 5) // 5 END AS label
  FROM ub, range(1, {CHAINS + 1}) c(chain), range(1, {DRAWS + 1}) t(iteration)),
ud AS (SELECT user_id, chain, iteration, min(birth) OVER (PARTITION BY chain, iteration, label) AS cluster FROM ul),
d AS (SELECT chain, iteration, obs, cluster, ev.user_id FROM ev JOIN ud USING (user_id))"""
TD = TU + f""",
tl AS (SELECT series, iteration::INTEGER AS iteration, obs, {h52("series || ':' || obs || ':' || iteration")} % 3 AS label
  FROM ta, range(1, {DRAWS + 1}) t(iteration)),
td AS (SELECT series, iteration, obs, min(obs) OVER (PARTITION BY series, iteration, label) AS cluster FROM tl)"""


def gaussian_marginal_sql(n: str, s: str, q: str, var: float, m0: float, tau: float) -> str:
    return (
        f"(-{n} / 2.0::DOUBLE * ln(2 * pi() * {var}) - 0.5::DOUBLE * ln(1 + {n} * {tau}::DOUBLE / {var})"
        f" - 0.5::DOUBLE * ({q} / {var} + {m0}::DOUBLE * {m0} / {tau}"
        f" - ({m0}::DOUBLE / {tau} + {s} / {var}) ^ 2 / (1 / {tau}::DOUBLE + {n} / {var}::DOUBLE)))"
    )


def gaussian_predictive_sql(x: str, n: str, s: str, var: float, m0: float, tau: float) -> str:
    precision = f"(1 / {tau}::DOUBLE + {n} / {var}::DOUBLE)"
    mean = f"(({m0}::DOUBLE / {tau} + {s} / {var}) / {precision})"
    spread = f"({var} + 1 / {precision})"
    return f"(-0.5::DOUBLE * ln(2 * pi() * {spread}) - 0.5::DOUBLE * ({x} - {mean}) ^ 2 / {spread})"
