"""Model scores: posteriors, marginals, predictives and leave-one-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import hash_uniform
from ..operators import choice, draws as dr, labels, likelihood as lk, prior, score, stats
from ..operators.stats import whiten
from ..plans import starts
from ..session import persist_reliably
from .base import (
    CA, CW, DP, DR, EA, FLAGS, STICKS, TK, TOPIC_MODEL, TOPICS, UA, UW, VALUES,
    customer_flags, customers, draws, events, gaussian_marginal_sql, gaussian_predictive_sql,
    h52, lb, query, r, table, turn_tokens, turns, users, white_users, with_vocabulary,
)

LB0 = lb("1.3::DOUBLE", "0.7::DOUBLE")
LBP = lb("1.5::DOUBLE", "4.0::DOUBLE")
VP = (400.0, 50.0, 2500.0)


def white_events(spark, sf):
    return whiten(events(spark, sf).withColumn("x", F.array("value")), VALUES)


@query("flagship_stick_posteriors", f"""WITH {CW} SELECT cluster, n_k, comp, round(1.3::DOUBLE + n_k - 1, 6) AS stick_a, round(0.7::DOUBLE + comp, 6) AS stick_b,
CASE WHEN cluster > 1 THEN round({lb('1.3::DOUBLE + n_k - 1', '0.7::DOUBLE + comp')} - {LB0}, 6) ELSE 0 END AS stick_score FROM cw""")
def flagship(spark, sf):
    """Each user-cluster's size, complement, stick posterior and share of the log likelihood."""
    out = prior.stick_posteriors(labels.cluster_sizes(events(spark, sf)), STICKS)
    return out.select(
        "cluster",
        "n_k",
        "comp",
        r("stick_a").alias("stick_a"),
        r("stick_b").alias("stick_b"),
        r(prior.stick_score(STICKS)).alias("stick_score"),
    )


# --- posteriors and marginals -----------------------------------------------


@query("m1_gaussian_posterior", f"""WITH {EA}, g AS (SELECT cluster, count(*) AS n, sum(value) AS s FROM ea GROUP BY 1)
SELECT cluster, n AS n_k, round((50.0 / 2500 + s / 400) / (1.0 / 2500 + n / 400.0::DOUBLE), 6) AS post_mean,
round(1 / (1.0 / 2500 + n / 400.0::DOUBLE), 6) AS post_var FROM g""")
def m1(spark, sf):
    out = lk.gaussian_posterior(stats.gaussian_stats(white_events(spark, sf), VALUES), VALUES)
    return out.select(
        "cluster", "n_k", r(F.col("post_mean")[0]).alias("post_mean"), r(F.col("post_cov")[0]).alias("post_var")
    )


@query("m2_dirichlet_posterior", f"""WITH {CA} SELECT series, cluster, term, sum(cnt)::BIGINT AS cnt, sum(cnt) + any_value(a) AS posterior
FROM ct JOIN ca USING (series, obs) JOIN al USING (term) GROUP BY ALL""")
def m2(spark, sf):
    rows = customers(spark, sf)
    held = stats.count_stats(customer_flags(spark, sf, rows), rows, ["series"], ["series", "obs"])
    return stats.dirichlet_posterior(held, FLAGS).select("series", "cluster", "term", "cnt", "posterior")


@query("m3_topic_posteriors", f"""WITH {TK} SELECT 'cluster' AS side, series || ':' || cluster AS owner, topic, count(*) AS cnt, round(count(*) + 0.3::DOUBLE, 6) AS posterior
FROM tk JOIN ta USING (series, obs) GROUP BY ALL
UNION ALL SELECT 'term', term, topic, count(*), round(count(*) + 0.1::DOUBLE, 6) FROM tk GROUP BY ALL""")
def m3(spark, sf):
    rows = turns(spark, sf)
    tokens = turn_tokens(rows)
    counts = stats.cluster_topics(stats.document_topics(tokens, ["series"]), rows, ["series"])
    topic, word = stats.topic_posteriors(counts, stats.topic_terms(tokens), TOPIC_MODEL)
    owner = F.concat_ws(":", "series", "cluster")
    left = topic.select(F.lit("cluster").alias("side"), owner.alias("owner"), "topic", "cnt", r("posterior").alias("posterior"))
    right = word.select(F.lit("term").alias("side"), F.col("term").alias("owner"), "topic", "cnt", r("posterior").alias("posterior"))
    return left.unionByName(right)


@query("m7_gaussian_marginal", f"""WITH {EA}, g AS (SELECT cluster, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM ea GROUP BY 1)
SELECT cluster, n AS n_k, round({gaussian_marginal_sql('n', 's', 'q', *VP)}, 6) AS log_marginal FROM g""")
def m7(spark, sf):
    out = stats.gaussian_stats(white_events(spark, sf), VALUES)
    return out.select("cluster", "n_k", r(lk.gaussian_marginal(VALUES)).alias("log_marginal"))


DM = f"""ck AS (SELECT series, cluster, term, sum(cnt)::BIGINT AS cnt FROM ct JOIN ca USING (series, obs) GROUP BY ALL),
cm AS (SELECT series, cluster, sum(cnt)::BIGINT AS total, sum(lgamma(cnt + a) - lgamma(a)) + lgamma(3.0) - lgamma(3.0::DOUBLE + sum(cnt)::DOUBLE) AS lm
  FROM ck JOIN al USING (term) GROUP BY ALL)"""


@query("m8_count_marginal", f"""WITH {CA}, {DM} SELECT series, cluster, total, round(lm, 6) AS log_marginal FROM cm""")
def m8(spark, sf):
    rows = customers(spark, sf)
    held = stats.count_stats(customer_flags(spark, sf, rows), rows, ["series"], ["series", "obs"])
    return lk.dirichlet_marginal(held, FLAGS, ["series"]).withColumn("log_marginal", r("log_marginal"))


@query("m9_topic_marginal", f"""WITH {TK}, k AS (SELECT series, cluster, topic, count(*) AS cnt FROM tk JOIN ta USING (series, obs) GROUP BY ALL),
w AS (SELECT topic, term, count(*) AS cnt FROM tk GROUP BY ALL)
SELECT 'cluster' AS part, series || ':' || cluster AS owner, round(sum(lgamma(cnt + 0.3::DOUBLE) - lgamma(0.3::DOUBLE)) + lgamma(1.2::DOUBLE) - lgamma(1.2::DOUBLE + sum(cnt)::DOUBLE), 5) AS log_marginal
FROM k GROUP BY series, cluster
UNION ALL SELECT 'topic', topic::VARCHAR, round(sum(lgamma(cnt + 0.1::DOUBLE) - lgamma(0.1::DOUBLE)) + lgamma(0.1::DOUBLE * any_value(v)) - lgamma(0.1::DOUBLE * any_value(v) + sum(cnt)::DOUBLE), 5)
FROM w CROSS JOIN (SELECT count(DISTINCT term) AS v FROM tk) GROUP BY topic""")
def m9(spark, sf):
    rows = turns(spark, sf)
    tokens = turn_tokens(rows)
    counts = stats.cluster_topics(stats.document_topics(tokens, ["series"]), rows, ["series"])
    per_cluster = lk.dirichlet_marginal(
        counts.withColumnRenamed("topic", "term"), TOPIC_MODEL.topics_as_counts(), ["series"]
    )
    left = per_cluster.select(
        F.lit("cluster").alias("part"), F.concat_ws(":", "series", "cluster").alias("owner"), r("log_marginal", 5).alias("log_marginal")
    )
    right = lk.topic_word_score(stats.topic_terms(tokens), with_vocabulary(TOPIC_MODEL, tokens)).select(
        F.lit("topic").alias("part"), F.col("topic").cast("string").alias("owner"), r("log_marginal", 5).alias("log_marginal")
    )
    return left.unionByName(right)


@query("m10_data_score", f"""WITH {CA}, {DM} SELECT series, round(sum(lm), 5) AS data_score FROM cm GROUP BY 1""")
def m10(spark, sf):
    rows = customers(spark, sf)
    held = stats.count_stats(customer_flags(spark, sf, rows), rows, ["series"], ["series", "obs"])
    out = lk.dirichlet_marginal(held, FLAGS, ["series"])
    return out.groupBy("series").agg(r(F.sum("log_marginal"), 5).alias("data_score"))


# --- partition priors -------------------------------------------------------

STICK_TERM = f"CASE WHEN cluster > 1 THEN {lb('1.3::DOUBLE + n_k - 1', '0.7::DOUBLE + comp')} - {LB0} ELSE 0 END"


@query("m11_assignment_score", f"""WITH {CW} SELECT sum(n_k)::BIGINT AS n, count(*) AS k, round(sum({STICK_TERM}), 4) AS stick_score FROM cw""")
def m11(spark, sf):
    out = prior.assignment_score(labels.cluster_sizes(events(spark, sf)), STICKS)
    return out.select("n", "k", r("stick_score", 4).alias("stick_score"))


@query("m11_series_score", f"""WITH {UW} SELECT series, round(sum({STICK_TERM}), 5) AS stick_score FROM cw GROUP BY 1""")
def m11_series(spark, sf):
    out = prior.assignment_score(labels.cluster_sizes(users(spark, sf), ["series"]), STICKS, ["series"])
    return out.select("series", r("stick_score", 5).alias("stick_score"))


@query("m12_arrival_posterior", f"""WITH {UW}, s AS (SELECT series, sum(n_k)::BIGINT AS n, count(*) AS k FROM cs GROUP BY 1)
SELECT series, n, k, 1.5::DOUBLE + k - 1 AS arrival_a, 4.0::DOUBLE + n - k AS arrival_b,
round({lb('1.5::DOUBLE + k - 1', '4.0::DOUBLE + n - k')} - {LBP}, 6) AS arrival_score FROM s""")
def m12(spark, sf):
    out = prior.arrival_posterior(labels.cluster_sizes(users(spark, sf), ["series"]), STICKS, ["series"])
    return out.withColumn("arrival_score", r("arrival_score"))


@query("m13_process_score", f"""WITH {UW}, s AS (SELECT series, sum(n_k)::DOUBLE AS n, count(*) AS k, sum(lgamma(n_k)) AS g FROM cs GROUP BY 1)
SELECT series, k, round(g + k * ln(2.0) + lgamma(2.0) - lgamma(n + 2.0), 5) AS assignment_score FROM s""")
def m13(spark, sf):
    out = prior.assignment_score(labels.cluster_sizes(users(spark, sf), ["series"]), DP, ["series"])
    return out.select("series", "k", r("assignment_score", 5).alias("assignment_score"))


JOINT = f"""g AS (SELECT d.chain, d.iteration, d.cluster, count(*) AS n_k, sum(value) AS s, sum(value * value) AS q FROM d JOIN ev USING (obs) GROUP BY ALL),
h AS (SELECT *, (coalesce(sum(n_k) OVER (PARTITION BY chain, iteration ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (cluster - 1))::BIGINT AS comp FROM g),
j AS (SELECT chain, iteration, sum({gaussian_marginal_sql('n_k', 's', 'q', *VP)}) AS data, sum({STICK_TERM}) AS sticks, sum(n_k)::BIGINT AS n, count(*) AS k, sum(lgamma(n_k)) AS lg FROM h GROUP BY ALL)"""


def white_draws(spark, sf):
    return whiten(draws(spark, sf, ("obs", "value")).withColumn("x", F.array("value")), VALUES)


@query("m14_joint_score", f"""WITH {DR}, {JOINT} SELECT chain, iteration,
round((data + sticks + {lb('1.5::DOUBLE + k - 1', '4.0::DOUBLE + n - k')} - {LBP}) / n, 7) AS per_observation FROM j""")
def m14(spark, sf):
    out = lk.joint_score(white_draws(spark, sf), VALUES, STICKS, ["chain", "iteration"])
    return out.select("chain", "iteration", r(F.col("joint_score") / F.col("n"), 7).alias("per_observation"))


@query("m14_joint_score_process", f"""WITH {DR}, {JOINT} SELECT chain, iteration,
round((data + lg + k * ln(2.0) + lgamma(2.0) - lgamma(n + 2.0::DOUBLE)) / n, 7) AS per_observation FROM j""")
def m14_dp(spark, sf):
    out = lk.joint_score(white_draws(spark, sf), VALUES, DP, ["chain", "iteration"])
    return out.select("chain", "iteration", r(F.col("joint_score") / F.col("n"), 7).alias("per_observation"))


@query("m14_joint_score_counts", f"""WITH {CA}, {DM}, cs AS (SELECT series, cluster, count(*) AS n_k FROM ca GROUP BY ALL),
cw AS (SELECT *, (coalesce(sum(n_k) OVER (PARTITION BY series ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (cluster - 1))::BIGINT AS comp FROM cs),
p AS (SELECT series, sum({STICK_TERM}) AS sticks, sum(n_k)::BIGINT AS n, count(*) AS k FROM cw GROUP BY 1),
q AS (SELECT series, sum(lm) AS data FROM cm GROUP BY 1)
SELECT series, round(coalesce(data, 0) + sticks + {lb('1.5::DOUBLE + k - 1', '4.0::DOUBLE + n - k')} - {LBP}, 5) AS joint_score FROM p LEFT JOIN q USING (series)""")
def m14_counts(spark, sf):
    rows = customers(spark, sf)
    terms = customer_flags(spark, sf, rows)
    out = lk.joint_score(rows, FLAGS, STICKS, ["series"], terms, ["series", "obs"])
    return out.select("series", r("joint_score", 5).alias("joint_score"))


# --- predictives ------------------------------------------------------------


@query("j2_candidate_scores", f"""WITH {UW}, g AS (SELECT series, cluster, count(*) AS n, sum(value) AS s FROM ua GROUP BY ALL)
SELECT ua.series, ua.obs, g.cluster AS candidate, round(ln(g.n) + {gaussian_predictive_sql('ua.value', 'g.n', 'g.s', *VP)}, 5) AS score FROM ua JOIN g USING (series)""")
def j2(spark, sf):
    rows = white_users(spark, sf)
    held = stats.gaussian_stats(rows, VALUES, ["series"]).select("series", F.col("cluster").alias("candidate"), "n_k", "s")
    data = lk.gaussian_predictive(VALUES, F.col("y"), F.col("n_k").cast("double"), F.col("s"))
    scored = rows.select("series", "obs", "y").join(held, "series")
    return scored.select("series", "obs", "candidate", r(F.ln("n_k") + data, 5).alias("score"))


@query("m4_gaussian_predictive", f"""WITH {UW}, g AS (SELECT series, cluster, count(*) AS n, sum(value) AS s FROM ua GROUP BY ALL)
SELECT ua.series, ua.obs, ua.cluster, round({gaussian_predictive_sql('ua.value', 'g.n', 'g.s', *VP)}, 5) AS log_data FROM ua JOIN g USING (series, cluster)""")
def m4(spark, sf):
    rows = white_users(spark, sf)
    held = stats.gaussian_stats(rows, VALUES, ["series"])
    from ..operators.joins import skew_join

    joined = skew_join(rows.select("series", "obs", "cluster", "y"), held, ["series", "cluster"], "n_k", "obs")
    data = lk.gaussian_predictive(VALUES, F.col("y"), F.col("n_k").cast("double"), F.col("s"))
    return joined.select("series", "obs", "cluster", r(data, 5).alias("log_data"))


@query("m5_count_predictive", f"""WITH {CA}, {DM},
pr AS (SELECT o.series, o.obs, c.cluster AS candidate FROM ca o JOIN (SELECT DISTINCT series, cluster FROM ca) c USING (series)),
z AS (SELECT pr.series, pr.obs, pr.candidate, al.term, coalesce(ct.cnt, 0) AS x, coalesce(ck.cnt, 0) + a AS post FROM pr CROSS JOIN al
 LEFT JOIN ct ON ct.series = pr.series AND ct.obs = pr.obs AND ct.term = al.term
 LEFT JOIN ck ON ck.series = pr.series AND ck.cluster = pr.candidate AND ck.term = al.term)
SELECT series, obs, candidate, round(lgamma(sum(x)::DOUBLE + 1) + lgamma(sum(post)) - lgamma(sum(post) + sum(x)::DOUBLE)
 + sum(lgamma(x + post) - lgamma(post) - lgamma(x + 1::DOUBLE)), 5) AS log_data FROM z GROUP BY ALL""")
def m5(spark, sf):
    rows = customers(spark, sf)
    # All three are read by several joins of the predictive.
    terms = persist_reliably(customer_flags(spark, sf, rows))
    held = persist_reliably(stats.count_stats(terms, rows, ["series"], ["series", "obs"]))
    clusters = rows.select("series", F.col("cluster").alias("candidate")).distinct()
    pairs = persist_reliably(rows.select("series", "obs", "cluster").join(clusters, "series"))
    out = lk.dirichlet_predictive(terms, held, pairs, FLAGS, ["series"])
    return out.select("series", "obs", "candidate", r("log_data", 5).alias("log_data"))


@query("m6_topic_predictive", f"""WITH {TK}, dt AS (SELECT series, obs, topic, count(*) AS cnt FROM tk GROUP BY ALL),
kt AS (SELECT series, cluster, topic, count(*) AS cnt FROM tk JOIN ta USING (series, obs) GROUP BY ALL),
pr AS (SELECT o.series, o.obs, c.cluster AS candidate FROM ta o JOIN (SELECT DISTINCT series, cluster FROM ta) c USING (series)),
z AS (SELECT pr.series, pr.obs, pr.candidate, coalesce(dt.cnt, 0) AS x, coalesce(kt.cnt, 0) + 0.3::DOUBLE AS post FROM pr CROSS JOIN range({TOPICS}) t(topic)
 LEFT JOIN dt ON dt.series = pr.series AND dt.obs = pr.obs AND dt.topic = t.topic
 LEFT JOIN kt ON kt.series = pr.series AND kt.cluster = pr.candidate AND kt.topic = t.topic)
SELECT series, obs, candidate, round(lgamma(sum(x)::DOUBLE + 1) + lgamma(sum(post)) - lgamma(sum(post) + sum(x)::DOUBLE)
 + sum(lgamma(x + post) - lgamma(post) - lgamma(x + 1::DOUBLE)), 5) AS log_data FROM z GROUP BY ALL""")
def m6(spark, sf):
    rows = turns(spark, sf)
    topics = stats.document_topics(turn_tokens(rows), ["series"])
    held = stats.cluster_topics(topics, rows, ["series"])
    clusters = rows.select("series", F.col("cluster").alias("candidate")).distinct()
    pairs = rows.select("series", "obs", "cluster").join(clusters, "series")
    named = topics.withColumnRenamed("topic", "term")
    out = lk.dirichlet_predictive(
        named, held.withColumnRenamed("topic", "term"), pairs, TOPIC_MODEL.topics_as_counts(), ["series"]
    )
    return out.select("series", "obs", "candidate", r("log_data", 5).alias("log_data"))


# --- leave-one-out ----------------------------------------------------------

# The definition, term by term: take the observation out, recount every
# cluster, and score each candidate from the recounted sticks.
LOO = """e AS (SELECT ua.series, ua.obs AS o, ua.cluster AS c, ua.value, cs.n_k = 1 AND ua.obs = ua.cluster AS single FROM ua JOIN cs USING (series, cluster)
  WHERE ua.obs > ua.cluster OR cs.n_k = 1),
l0 AS (SELECT e.series, o, c, single, cs.cluster AS l, cs.n_k - (cs.cluster = c)::INT AS n FROM e JOIN cs USING (series)),
l1 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY series, o ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS older FROM l0),
l2 AS (SELECT series, o, c, l, n, 1.3::DOUBLE + n - 1 AS a, 0.7::DOUBLE + older - (l - 1) + (o < l)::INT AS b FROM l1 WHERE n > 0),
tt AS (SELECT series, o, count(*) AS k, sum(n)::BIGINT AS m FROM l2 GROUP BY ALL),
cmp AS (SELECT e.series, e.o, (coalesce((SELECT sum(n) FROM l2 WHERE l2.series = e.series AND l2.o = e.o AND l2.l < e.o), 0) - (e.o - 1))::BIGINT AS comp FROM e),
ex AS (SELECT k.series, k.o, k.c, k.l AS candidate,
  CASE WHEN k.l < k.o THEN CASE WHEN k.l > 1 THEN ln(k.a / (k.a + k.b)) ELSE 0 END
    + coalesce(sum(ln(l.b / (l.a + l.b))) FILTER (l.l > k.l AND l.l < k.o), 0)
  ELSE coalesce(sum(lgamma(l.b + k.n) - lgamma(l.a + l.b + k.n) - lgamma(l.b) + lgamma(l.a + l.b)) FILTER (l.l > k.o AND l.l < k.l), 0)
    - """ + lb("k.a", "k.b") + " + CASE WHEN k.o > 1 THEN " + lb("k.a + 1", "0.7::DOUBLE + cmp.comp") + " ELSE " + LB0 + """ END END
  + ln((4.0::DOUBLE + tt.m - tt.k) / (4.5::DOUBLE + tt.m)) AS log_prior
  FROM l2 k JOIN l2 l USING (series, o) JOIN cmp USING (series, o) JOIN tt USING (series, o)
  GROUP BY k.series, k.o, k.c, k.l, k.a, k.b, k.n, cmp.comp, tt.m, tt.k),
nw AS (SELECT e.series, e.o, e.c, e.o AS candidate, CASE WHEN tt.k IS NULL THEN 0 ELSE ln((1.5::DOUBLE + tt.k - 1) / (4.5::DOUBLE + tt.m)) END + """ + lb("1.3::DOUBLE", "0.7::DOUBLE + comp") + f""" - {LB0} AS log_prior
  FROM e JOIN cmp USING (series, o) LEFT JOIN tt USING (series, o)),
sc AS (SELECT *, FALSE AS is_new FROM ex UNION ALL SELECT *, TRUE FROM nw)"""
GS = f"""gs AS (SELECT series, cluster, count(*) AS n, sum(value) AS s FROM ua GROUP BY ALL),
fs AS (SELECT sc.series, sc.o AS obs, sc.candidate, sc.is_new, log_prior + {gaussian_predictive_sql('e.value', "(CASE WHEN is_new THEN 0 ELSE gs.n - (sc.candidate = sc.c)::INT END)", "(CASE WHEN is_new THEN 0 ELSE gs.s - (CASE WHEN sc.candidate = sc.c THEN e.value ELSE 0 END) END)", *VP)} AS score
  FROM sc JOIN e ON e.series = sc.series AND e.o = sc.o LEFT JOIN gs ON gs.series = sc.series AND gs.cluster = sc.candidate)"""


@query("m15_existing_predictive", f"""WITH {UW}, {LOO} SELECT series, o AS obs, candidate, round(log_prior, 5) AS log_prior FROM ex""")
def m15(spark, sf):
    out = score.prior_scores(users(spark, sf), STICKS, ["series"]).filter(~F.col("is_new"))
    return out.select("series", "obs", "candidate", r("log_prior", 5).alias("log_prior"))


@query("m16_new_predictive", f"""WITH {UW}, {LOO} SELECT series, o AS obs, round(log_prior, 5) AS log_prior FROM nw""")
def m16(spark, sf):
    out = score.prior_scores(users(spark, sf), STICKS, ["series"], rebirth=False).filter(F.col("is_new"))
    return out.select("series", "obs", r("log_prior", 5).alias("log_prior"))


@query("m17_process_predictives", f"""WITH {UW}, e AS (SELECT ua.series, ua.obs AS o, ua.cluster AS c FROM ua JOIN cs USING (series, cluster) WHERE ua.obs > ua.cluster OR cs.n_k = 1)
SELECT e.series, e.o AS obs, cs.cluster AS candidate, FALSE AS is_new, round(ln(cs.n_k - (cs.cluster = c)::INT), 6) AS log_prior FROM e JOIN cs USING (series) WHERE cs.n_k > (cs.cluster = c)::INT
UNION ALL SELECT series, o, o, TRUE, round(ln(2.0), 6) FROM e""")
def m17(spark, sf):
    out = score.prior_scores(users(spark, sf), DP, ["series"])
    return out.select("series", "obs", "candidate", "is_new", r("log_prior").alias("log_prior"))


@query("m18_leave_one_out", f"""WITH {UW}, {LOO}, {GS} SELECT series, obs, candidate, is_new, round(score, 5) AS score FROM fs""")
def m18(spark, sf):
    out = score.leave_one_out(white_users(spark, sf), VALUES, STICKS, ["series"])
    return out.select("series", "obs", "candidate", "is_new", r("score", 5).alias("score"))


CLOO = CA + """,
ua AS (SELECT series, obs, cluster, 0 AS value FROM ca), cs AS (SELECT series, cluster, count(*) AS n_k FROM ua GROUP BY ALL),
ck AS (SELECT series, cluster, term, sum(cnt)::BIGINT AS cnt FROM ct JOIN ca USING (series, obs) GROUP BY ALL)"""


@query("m18_leave_one_out_counts", f"""WITH {CLOO}, {LOO},
z AS (SELECT sc.series, sc.o, sc.candidate, sc.is_new, sc.log_prior, coalesce(x.cnt, 0) AS x,
  a + CASE WHEN is_new THEN 0 ELSE coalesce(k.cnt, 0) - CASE WHEN sc.candidate = sc.c THEN coalesce(x.cnt, 0) ELSE 0 END END AS post
  FROM sc CROSS JOIN al LEFT JOIN ct x ON x.series = sc.series AND x.obs = sc.o AND x.term = al.term
  LEFT JOIN ck k ON k.series = sc.series AND k.cluster = sc.candidate AND k.term = al.term)
SELECT series, o AS obs, candidate, is_new, round(log_prior + lgamma(sum(x)::DOUBLE + 1) + lgamma(sum(post)) - lgamma(sum(post) + sum(x)::DOUBLE)
 + sum(lgamma(x + post) - lgamma(post) - lgamma(x + 1::DOUBLE)), 5) AS score FROM z GROUP BY series, o, candidate, is_new, log_prior""")
def m18_counts(spark, sf):
    rows = customers(spark, sf)
    terms = customer_flags(spark, sf, rows)
    out = score.leave_one_out(rows, FLAGS, STICKS, ["series"], terms)
    return out.select("series", "obs", "candidate", "is_new", r("score", 5).alias("score"))


@query("m19_best_cluster", f"""WITH {UW}, {LOO}, {GS} SELECT series, obs, arg_max(candidate, score) AS best, round(max(score), 5) AS best_score FROM fs GROUP BY ALL""")
def m19(spark, sf):
    out = score.best_candidates(score.leave_one_out(white_users(spark, sf), VALUES, STICKS, ["series"]), ["series"])
    return out.withColumn("best_score", r("best_score", 5))


@query("u1_candidate_sets", f"""WITH {UW}, e AS (SELECT ua.series, ua.obs, ua.cluster, cs.n_k = 1 AS single FROM ua JOIN cs USING (series, cluster) WHERE ua.obs > ua.cluster OR cs.n_k = 1)
SELECT e.series, e.obs, cs.cluster AS candidate, FALSE AS is_new FROM e JOIN cs USING (series) WHERE NOT (single AND cs.cluster = e.obs)
UNION ALL SELECT series, obs, obs, TRUE FROM e""")
def u1(spark, sf):
    rows = users(spark, sf)
    sizes = labels.cluster_sizes(rows, ["series"])
    pairs = score.candidate_pairs(score.scored_rows(rows, sizes, ["series"]), sizes, ["series"])
    return pairs.select("series", "obs", "candidate", "is_new")


@query("j4_younger_clusters_between", f"""WITH {UW} SELECT ua.series, ua.obs, count(cs.cluster) AS between_clusters, coalesce(sum(cs.n_k), 0)::BIGINT AS between_members
FROM ua LEFT JOIN cs ON cs.series = ua.series AND cs.cluster > ua.cluster AND cs.cluster < ua.obs GROUP BY ALL""")
def j4(spark, sf):
    from ..operators.ranges import clusters_between

    return clusters_between(users(spark, sf), ["series"])


# --- weights and categorical draws ------------------------------------------

USER_WEIGHTS = "w AS (SELECT user_id, event_id, -value / 50 AS lw FROM events)"


def user_weights(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", (-F.col("value") / 50).alias("lw"))


@query("a8_normalised_weights", f"""WITH {USER_WEIGHTS} SELECT user_id, event_id, round(exp(lw - max(lw) OVER p) / sum(exp(lw)) OVER p * exp(max(lw) OVER p), 8) AS weight FROM w WINDOW p AS (PARTITION BY user_id)""")
def a8(spark, sf):
    out = dr.normalised_weights(user_weights(spark, sf), "lw", ["user_id"])
    return out.select("user_id", "event_id", r("weight", 8).alias("weight"))


@query("a9_effective_size", f"""WITH {USER_WEIGHTS} SELECT user_id, round(sum(exp(lw)) ^ 2 / sum(exp(lw) ^ 2), 6) AS ess FROM w GROUP BY 1""")
def a9(spark, sf):
    return dr.effective_size(user_weights(spark, sf), "lw", ["user_id"]).withColumn("ess", r("ess"))


GUMBEL = "-ln(-ln(CASE WHEN {h} = 0 THEN 2.0::DOUBLE ^ -53 ELSE {h} / 4503599627370496.0::DOUBLE END))"


@query("t2_gumbel_choice", f"""WITH {UW}, {LOO}, {GS} SELECT series, obs, arg_max(candidate, score + {GUMBEL.format(h=h52("series || ':' || obs || ':' || candidate"))}) AS candidate FROM fs GROUP BY ALL""")
def t2(spark, sf):
    scores = score.leave_one_out(white_users(spark, sf), VALUES, STICKS, ["series"])
    uniform = hash_uniform(choice.key_of("series", "obs", "candidate"))
    return choice.gumbel_choice(scores, ["series", "obs"], "candidate", "score", uniform).select("series", "obs", "candidate")


@query("t3_gumbel_resample", f"""WITH {USER_WEIGHTS} SELECT user_id, draw::INTEGER AS draw, arg_max(event_id, lw + {GUMBEL.format(h=h52("'s:' || user_id || ':' || event_id || ':' || draw"))}) AS event_id
FROM w, range(1, 5) t(draw) GROUP BY ALL""")
def t3(spark, sf):
    out = choice.gumbel_resample(user_weights(spark, sf), ["user_id"], "event_id", "lw", 4, "s")
    return out.select("user_id", "draw", "event_id")


# --- starts -----------------------------------------------------------------

START = f"""s0 AS (SELECT series, obs, obs = 1 OR {h52("'7:coin:' || series || ':' || obs")} / 4503599627370496.0::DOUBLE < 0.1 AS born FROM us),
s1 AS (SELECT *, (sum(born::INT) OVER (PARTITION BY series ORDER BY obs))::BIGINT AS alive FROM s0),
s2 AS (SELECT series, obs, born, CASE WHEN born THEN alive ELSE {{low}} + floor({h52("'7:pick:' || series || ':' || obs")} / 4503599627370496.0::DOUBLE * (alive - {{low}} + 1))::BIGINT END AS pick FROM s1),
b AS (SELECT series, obs AS cluster, alive AS pick FROM s1 WHERE born)"""


@query("g1_random_start", f"""WITH {UA}, {START.format(low='1')} SELECT series, obs, cluster FROM s2 JOIN b USING (series, pick)""")
def g1(spark, sf):
    return starts.random_start(users(spark, sf), ["series"], seed=7)


@query("g1_recent_random_start", f"""WITH {UA}, {START.format(low='greatest(1, alive - 2)')} SELECT series, obs, cluster FROM s2 JOIN b USING (series, pick)""")
def g1_recent(spark, sf):
    return starts.random_start(users(spark, sf), ["series"], seed=7, radius=2)


@query("g1_fixed_starts", f"""WITH {UA} SELECT series, obs, 'all same cluster' AS start, 1::BIGINT AS cluster FROM ua UNION ALL SELECT series, obs, 'all different clusters', obs FROM ua""")
def g1_fixed(spark, sf):
    rows = users(spark, sf).select("series", "obs")
    same = starts.fixed_start(rows, "all same cluster").withColumn("start", F.lit("all same cluster"))
    apart = starts.fixed_start(rows, "all different clusters").withColumn("start", F.lit("all different clusters"))
    return same.unionByName(apart).select("series", "obs", "start", "cluster")
