"""Sources, labels, windows and plain statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import lbeta, lfactorial, lgamma, log_multivariate_beta, mvn_logpdf, mvt_logpdf
from ..operators.joins import skew_join
from ..operators import checks, draws as dr, labels, order, prior, similarity, stats
from ..session import scratch_path
from ..sources import tables
from .base import (
    CA, CW, DR, EA, EV, STICKS, TK, TU, UA, UW, TOPICS,
    customer_flags, customers, draws, events, h52, lb, query, r, table, turn_tokens, turns, users,
)


# --- sources and sinks ------------------------------------------------------


@query("s1_ordered_observations", """SELECT row_number() OVER (ORDER BY ts, event_id) AS obs, event_id, user_id FROM events""")
def s1(spark, sf):
    raw = table(spark, sf, "events").select("ts", "event_id", "user_id")
    return tables.ordered_observations(raw, ["ts", "event_id"]).select("obs", "event_id", "user_id")


@query("s1_series_observations", f"""WITH {UA} SELECT series, obs, event_type FROM ua""")
def s1_series(spark, sf):
    raw = table(spark, sf, "events").select(F.col("user_id").alias("series"), "ts", "event_id", "event_type")
    return tables.ordered_observations(raw, ["ts", "event_id"], ["series"]).select("series", "obs", "event_type")


@query("s2_document_terms", """WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents)
SELECT doc_id, term, count(*) AS cnt FROM w WHERE term <> '' GROUP BY ALL""")
def s2(spark, sf):
    return tables.term_counts(table(spark, sf, "documents"), ["doc_id"])


@query("s3_clustering_csv", """SELECT doc_id AS obs, min(doc_id) OVER (PARTITION BY lang, source) AS cluster, length(text) AS chars,
md5(text) AS digest FROM documents""")
def s3(spark, sf):
    docs = table(spark, sf, "documents")
    first = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("cluster"), F.count("*").alias("_size"))
    rows = skew_join(docs, first, ["lang", "source"], size="_size", spread="doc_id").select(
        F.col("doc_id").cast("string").alias("timestamp"), F.col("text").alias("tweet"), "cluster"
    )
    path = scratch_path(spark, "clustering")
    tables.write_clustering_csv(rows, path)
    back = tables.read_clustering_csv(spark, path)
    return back.select(
        F.col("timestamp").cast("bigint").alias("obs"),
        "cluster",
        F.length("tweet").cast("bigint").alias("chars"),
        F.md5("tweet").alias("digest"),
    )


@query("s4_draws_sink", f"""WITH {DR} SELECT chain, iteration, obs, cluster FROM d WHERE iteration > 4 AND iteration % 4 = 0""")
def s4(spark, sf):
    path = scratch_path(spark, "draws")
    tables.write_iterations(draws(spark, sf), path)
    kept = labels.keep_iterations(tables.read_draws(spark, path), 4, 4)
    return kept.select("chain", "iteration", "obs", "cluster")


@query("s5_wide_frame", """WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS obs, p_brand, p_size::DOUBLE AS x1, p_retailprice AS x2 FROM part),
q AS (SELECT obs, min(obs) OVER (PARTITION BY p_brand) AS cluster, x1, x2 FROM p)
SELECT obs, cluster, 0::INTEGER AS dim, x1 AS value FROM q UNION ALL SELECT obs, cluster, 1::INTEGER, x2 FROM q""")
def s5(spark, sf):
    wide = tables.from_wide(table(spark, sf, "part"), ["p_partkey"], "p_brand", ["p_size", "p_retailprice"])
    return tables.long_values(wide)


# --- projections and predicates ---------------------------------------------


@query("p1_keep_iterations", f"""WITH {DR} SELECT chain, iteration, count(*) AS observations FROM d
WHERE iteration > 5 AND iteration % 3 = 0 GROUP BY ALL""")
def p1(spark, sf):
    kept = labels.keep_iterations(draws(spark, sf), 5, 3)
    return kept.groupBy("chain", "iteration").agg(F.count("*").alias("observations"))


@query("p2_one_hot", f"""WITH {EA} SELECT cluster, obs, 1::BIGINT AS value FROM ea""")
def p2(spark, sf):
    return labels.one_hot(events(spark, sf))


@query("p2_one_hot_dense", f"""WITH {UA}, z AS (SELECT series, obs, dense_rank() OVER (PARTITION BY series ORDER BY cluster) AS k FROM ua)
SELECT series, obs, (k = 1)::BIGINT AS c1, (k = 2)::BIGINT AS c2, (k = 3)::BIGINT AS c3, (k = 4)::BIGINT AS c4, (k = 5)::BIGINT AS c5 FROM z""")
def p2_dense(spark, sf):
    # A cluster is an event type, so a series has no more clusters than there are types.
    most = table(spark, sf, "events").select("event_type").distinct().count()
    return labels.one_hot_dense(users(spark, sf), most, ["series"])


@query("p3_canonical_labels", f"""WITH {EA} SELECT obs, cluster FROM ea""")
def p3(spark, sf):
    return events(spark, sf).select("obs", "cluster")


@query("p3_blocks_to_labels", f"""WITH {UA} SELECT series, obs, cluster FROM ua""")
def p3_blocks(spark, sf):
    blocks = users(spark, sf).groupBy("series", "event_type").agg(F.collect_list("obs").alias("members"))
    return labels.blocks_to_assignments(blocks, ["series"])


@query("p4_contiguous_labels", f"""WITH {EA} SELECT obs, cluster, dense_rank() OVER (ORDER BY cluster) AS rank FROM ea""")
def p4(spark, sf):
    return labels.contiguous_labels(events(spark, sf)).select("obs", "cluster", "rank")


@query("p5_arrival_flag", f"""WITH {EA} SELECT obs, cluster, obs = cluster AS is_arrival FROM ea""")
def p5(spark, sf):
    return labels.arrivals(events(spark, sf)).select("obs", "cluster", "is_arrival")


@query("p6_eligible_rows", f"""WITH {UA}, z AS (SELECT *, count(*) OVER (PARTITION BY series, cluster) AS n_k FROM ua)
SELECT series, obs, cluster, n_k FROM z WHERE obs > cluster OR n_k = 1""")
def p6(spark, sf):
    return labels.eligible_to_move(users(spark, sf), ["series"]).select("series", "obs", "cluster", "n_k")


@query("p7_input_checks", f"""WITH {CA}
SELECT 'null_value' AS check_name, count(*) FILTER (obs IS NULL OR term IS NULL OR cnt IS NULL) AS violations FROM ct
UNION ALL SELECT 'negative_count', count(*) FILTER (cnt < 0) FROM ct
UNION ALL SELECT 'null_vector', count(*) FILTER (embedding IS NULL) FROM embeddings
UNION ALL SELECT 'wrong_dimension', count(*) FILTER (len(embedding) <> 64) FROM embeddings
UNION ALL SELECT 'bad_value', count(*) FILTER (len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0) FROM embeddings""")
def p7(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("embedding").alias("x"))
    counts = customer_flags(spark, sf, customers(spark, sf))
    return checks.check_counts(counts).unionByName(checks.check_vectors(vectors, 64))


@query("p8_unmatched_iterations", f"""WITH {DR}, l AS (SELECT DISTINCT chain, iteration FROM d),
t AS (SELECT chain, iteration FROM l WHERE (chain + iteration) % 7 <> 0)
SELECT chain, iteration, 'draws' AS side FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.chain = l.chain AND t.iteration = l.iteration)""")
def p8(spark, sf):
    rows = draws(spark, sf)
    trace = dr.clusters_per_draw(rows).filter((F.col("chain") + F.col("iteration")) % 7 != 0)
    return dr.unmatched_iterations(rows, trace)


# --- scalar functions over data ---------------------------------------------


@query("f1_lgamma", """SELECT event_id, round(lgamma(value + 0.25), 6) AS lg FROM events""")
def f1(spark, sf):
    return table(spark, sf, "events").select("event_id", r(lgamma(F.col("value") + 0.25)).alias("lg"))


@query("f2_lbeta", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({lb('l_quantity', '1 + l_discount * 100')}, 6) AS lb FROM lineitem""")
def f2(spark, sf):
    score = lbeta(F.col("l_quantity"), 1 + F.col("l_discount") * 100)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(score).alias("lb"))


@query("f3_log_multivariate_beta", f"""WITH {CA}, t AS (SELECT series, obs, sum(cnt + a) AS total, sum(lgamma(cnt + a)) AS parts FROM ct JOIN al USING (term) GROUP BY ALL)
SELECT series, obs, round(parts - lgamma(total), 6) AS lmb FROM t""")
def f3(spark, sf):
    from .base import FLAGS

    terms = customer_flags(spark, sf, customers(spark, sf))
    lists = terms.groupBy("series", "obs").agg(
        F.sort_array(F.collect_list(F.col("cnt") + FLAGS.scale_of(F.col("term")))).alias("a")
    )
    return lists.select("series", "obs", r(log_multivariate_beta(F.col("a"))).alias("lmb"))


@query("f4_log_multinomial", f"""WITH {CA} SELECT series, obs, round(lgamma(sum(cnt)::DOUBLE + 1) - sum(lgamma(cnt + 1::DOUBLE)), 6) AS lmc FROM ct GROUP BY ALL""")
def f4(spark, sf):
    terms = customer_flags(spark, sf, customers(spark, sf))
    coefficient = lfactorial(F.sum("cnt")) - F.sum(lfactorial(F.col("cnt")))
    return terms.groupBy("series", "obs").agg(r(coefficient).alias("lmc"))


@query("f5_student_t", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
round(lgamma(3.5) - lgamma(2.5) - ln(5 * pi()) - 0.5 * ln(100.0 * 0.0025)
 - 3.5 * ln(1 + ((l_quantity - 25) ^ 2 / 100.0 + (l_discount - 0.05) ^ 2 / 0.0025) / 5), 6) AS logpdf FROM lineitem""")
def f5(spark, sf):
    x = F.array("l_quantity", "l_discount")
    density = mvt_logpdf(x, [25.0, 0.05], [[100.0, 0.0], [0.0, 0.0025]], 5.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(density).alias("logpdf"))


@query("f6_normal", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 25 AS u, l_tax * 100 - 4 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
round(-ln(2 * pi()) - 0.5 * ln(100.0 * 4 - 9) - 0.5 * (4 * u * u - 6 * u * v + 100 * v * v) / (100.0 * 4 - 9), 6) AS logpdf FROM c""")
def f6(spark, sf):
    x = F.array(F.col("l_quantity"), F.col("l_tax") * 100)
    density = mvn_logpdf(x, [25.0, 4.0], [[100.0, 3.0], [3.0, 4.0]])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(density).alias("logpdf"))


@query("f7_dirichlet_multinomial", f"""WITH {CA} SELECT series, obs, round(lgamma(sum(cnt)::DOUBLE + 1) + lgamma(3.0) - lgamma(3.0 + sum(cnt)::DOUBLE)
 + sum(lgamma(cnt + a) - lgamma(a) - lgamma(cnt + 1::DOUBLE)), 6) AS logpmf FROM ct JOIN al USING (term) GROUP BY ALL""")
def f7(spark, sf):
    from .base import FLAGS

    terms = customer_flags(spark, sf, customers(spark, sf))
    a = FLAGS.scale_of(F.col("term"))
    total = F.sum("cnt")
    value = (
        lgamma(total + F.lit(1.0))
        + lgamma(FLAGS.total)
        - lgamma(total + F.lit(FLAGS.total))
        + F.sum(lgamma(F.col("cnt") + a) - lgamma(a) - lgamma(F.col("cnt") + F.lit(1.0)))
    )
    return terms.groupBy("series", "obs").agg(r(value).alias("logpmf"))


# --- statistics per cluster -------------------------------------------------


@query("a1_cluster_sizes", f"""WITH {EA} SELECT cluster, count(*) AS n_k FROM ea GROUP BY 1""")
def a1(spark, sf):
    return labels.cluster_sizes(events(spark, sf))


@query("a2_gaussian_stats", f"""WITH {EA} SELECT cluster, count(*) AS n_k, round(avg(value), 10) AS mean, round(sum(value * value), 4) AS sum_sq FROM ea GROUP BY 1""")
def a2(spark, sf):
    rows = events(spark, sf).withColumn("x", F.array("value"))
    out = stats.moments(rows)
    return out.select("cluster", "n_k", r(F.col("mean")[0], 10).alias("mean"), r("sum_sq", 4).alias("sum_sq"))


@query("a2_vector_stats", """WITH o AS (SELECT row_number() OVER (ORDER BY vec_id) AS obs, label, embedding FROM embeddings),
c AS (SELECT min(obs) OVER (PARTITION BY label) AS cluster, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM o)
SELECT cluster, dim::INTEGER AS dim, count(*) AS n_k, round(avg(v), 6) AS mean FROM c GROUP BY ALL""")
def a2_vectors(spark, sf):
    raw = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    rows = tables.assigned_observations(raw, ["vec_id"], ["label"])
    out = stats.moments(rows, dim=64)
    return out.select("cluster", "n_k", F.posexplode("mean").alias("dim", "mean")).select(
        "cluster", "dim", "n_k", r("mean").alias("mean")
    )


@query("a3_count_stats", """WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) AS obs, lang, source, text FROM documents),
c AS (SELECT min(obs) OVER (PARTITION BY lang, source) AS cluster, text FROM o),
w AS (SELECT cluster, unnest(string_split(lower(text), ' ')) AS term FROM c)
SELECT cluster, term, count(*) AS cnt FROM w WHERE term <> '' GROUP BY ALL""")
def a3(spark, sf):
    docs = table(spark, sf, "documents")
    rows = tables.assigned_observations(docs.select("doc_id", "lang", "source"), ["doc_id"], ["lang", "source"])
    terms = tables.term_counts(docs, ["doc_id"])
    return stats.count_stats(terms, rows, on=["doc_id"])


@query("a4_cluster_topics", f"""WITH {TK} SELECT series, cluster, topic, count(*) AS cnt FROM tk JOIN ta USING (series, obs) GROUP BY ALL""")
def a4_cluster(spark, sf):
    rows = turns(spark, sf)
    return stats.cluster_topics(stats.document_topics(turn_tokens(rows), ["series"]), rows, ["series"])


@query("a4_document_topics", f"""WITH {TK} SELECT series, obs, topic, count(*) AS cnt FROM tk GROUP BY ALL""")
def a4_document(spark, sf):
    return stats.document_topics(turn_tokens(turns(spark, sf)), ["series"])


@query("a4_topic_terms", f"""WITH {TK} SELECT topic, term, count(*) AS cnt FROM tk GROUP BY ALL""")
def a4_terms(spark, sf):
    return stats.topic_terms(turn_tokens(turns(spark, sf)))


@query("a7_fixed_histogram", """WITH e AS (SELECT * FROM (VALUES (1, 0.0::DOUBLE, 10.0::DOUBLE), (2, 10.0, 20.0), (3, 20.0, 50.0), (4, 50.0, 100.0), (5, 100.0, 200.0), (6, 200.0, 9000.0)) v(bin, low, high)),
u AS (SELECT DISTINCT event_type FROM events)
SELECT u.event_type, e.bin::INTEGER AS bin, e.low, e.high, count(ev.value) AS cnt FROM u CROSS JOIN e
LEFT JOIN events ev ON ev.event_type = u.event_type AND ev.value > e.low AND ev.value <= e.high GROUP BY ALL""")
def a7(spark, sf):
    edges = [0.0, 10.0, 20.0, 50.0, 100.0, 200.0, 9000.0]
    return dr.fixed_histogram(table(spark, sf, "events").select("event_type", "value"), "value", edges, ["event_type"])


@query("a17_distortion", """WITH c AS (SELECT label, avg_list AS m FROM (SELECT label, dim, avg(v) AS avg_list FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL)),
s AS (SELECT label, dim, sum(v * v) - sum(v) * sum(v) / count(*) AS sse, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL)
SELECT label, max(n) AS n_k, round(sum(sse), 5) AS distortion FROM s GROUP BY 1""")
def a17(spark, sf):
    from ..plans.elbow import distortion

    raw = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("x"))
    return distortion(raw, 64).select(F.col("cluster").alias("label"), "n_k", r("distortion", 5).alias("distortion"))


@query("a17_elbow_curve")
def a17_curve(spark, sf):
    from ..plans.elbow import elbow_curve

    raw = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    return elbow_curve(raw, 64, range(1, 7))


# --- windows ----------------------------------------------------------------


@query("w1_complement_counts", f"""WITH {CW} SELECT cluster, n_k, comp FROM cw""")
def w1(spark, sf):
    return prior.complement_counts(labels.cluster_sizes(events(spark, sf)))


@query("w2_stick_posterior", f"""WITH {CW} SELECT cluster, n_k, comp, round(1.3 + n_k - 1, 6)::DOUBLE AS stick_a, round(0.7 + comp, 6)::DOUBLE AS stick_b FROM cw""")
def w2(spark, sf):
    out = prior.stick_posteriors(labels.cluster_sizes(events(spark, sf)), STICKS)
    return out.select("cluster", "n_k", "comp", r("stick_a").alias("stick_a"), r("stick_b").alias("stick_b"))


PSI = "CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE (1.3::DOUBLE + n_k - 1) / (2.0::DOUBLE + n_k - 1 + comp) END"


def mean_sticks(spark, sf):
    sizes = labels.cluster_sizes(users(spark, sf), ["series"])
    sticks = labels.cluster_ranks(prior.stick_posteriors(sizes, STICKS, ["series"]), ["series"])
    psi = F.when(F.col("rank") == 1, F.lit(1.0)).otherwise(F.col("stick_a") / (F.col("stick_a") + F.col("stick_b")))
    return sticks.select("series", "rank", psi.alias("psi"))


@query("w3_log_pmf_triangle", f"""WITH {UW}, z AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY cluster) AS k FROM cw),
p AS (SELECT series, k, {PSI} AS psi FROM z)
SELECT s.series, s.k AS stage, c.k AS choice,
round(ln(c.psi) + coalesce((SELECT sum(ln(1 - l.psi)) FROM p l WHERE l.series = s.series AND l.k > c.k AND l.k <= s.k), 0), 6) AS log_pmf
FROM p s JOIN p c ON s.series = c.series AND c.k <= s.k""")
def w3(spark, sf):
    return prior.log_pmf_triangle(mean_sticks(spark, sf), ["series"]).withColumn("log_pmf", r("log_pmf"))


@query("w4_segments", f"""WITH {EA} SELECT obs, (sum((obs = cluster)::BIGINT) OVER (ORDER BY obs))::BIGINT AS segment FROM ea""")
def w4(spark, sf):
    flagged = labels.arrivals(events(spark, sf))
    return order.segment_ids(flagged, "is_arrival").select("obs", "segment")


@query("w5_clusters_alive", f"""WITH {EA}, z AS (SELECT obs, (sum((obs = cluster)::BIGINT) OVER (ORDER BY obs))::BIGINT AS alive, (obs = cluster)::BIGINT AS a FROM ea)
SELECT obs, alive - a AS alive_before, alive FROM z""")
def w5(spark, sf):
    return order.alive_clusters(events(spark, sf)).select("obs", "alive_before", "alive")


@query("w6_births_after_removal", f"""WITH {EA} SELECT cluster, count(*) AS n_k, coalesce(min(obs) FILTER (obs > cluster), 0) AS next_birth FROM ea GROUP BY 1""")
def w6(spark, sf):
    out = labels.births_after_removal(events(spark, sf))
    return out.withColumn("next_birth", F.coalesce("next_birth", F.lit(0)))


@query("w6_moved_labels", f"""WITH {UA}, m AS (SELECT *, CASE WHEN obs % 9 = 4 THEN 'new:' || obs WHEN obs % 9 = 7 AND obs <> 1 THEN 'old:1' ELSE 'old:' || cluster END AS lab FROM ua)
SELECT series, obs, min(obs) OVER (PARTITION BY series, lab) AS cluster FROM m""")
def w6_moves(spark, sf):
    rows = users(spark, sf).select("series", "obs", "cluster")
    o = F.col("obs")
    target = F.when(o % 9 == 4, o).when((o % 9 == 7) & (o != 1), F.lit(1).cast("bigint"))
    moves = rows.select("series", "obs", target.alias("new_cluster")).filter(F.col("new_cluster").isNotNull())
    return labels.move_observations(rows, moves, ["series"]).select("series", "obs", "cluster")


@query("w7_neighbour_candidates", f"""WITH {EA}, c AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS k FROM ea GROUP BY cluster),
o AS (SELECT ea.obs, ea.cluster, c.k FROM ea JOIN c USING (cluster))
SELECT o.obs, o.cluster, c.cluster AS candidate FROM o JOIN c ON c.cluster < o.obs AND c.k BETWEEN o.k - 2 AND o.k + 2
UNION ALL SELECT obs, cluster, obs FROM o""")
def w7(spark, sf):
    return labels.neighbour_candidates(events(spark, sf), 2)


# --- scatter and joins ------------------------------------------------------


@query("d1_assignment_scatter", f"""WITH {EA} SELECT obs, cluster FROM ea""")
def d1(spark, sf):
    return events(spark, sf).select("obs", "cluster")


@query("j3_contingency", """SELECT quality AS u, toxic AS v, count(*) AS cell FROM labels GROUP BY ALL""")
def j3(spark, sf):
    pairs = table(spark, sf, "labels")
    left = pairs.select(F.col("doc_id").alias("obs"), F.col("quality").alias("u"))
    right = pairs.select(F.col("doc_id").alias("obs"), F.col("toxic").alias("v"))
    return similarity.contingency(left, right)


@query("ps4_adjusted_rand", """WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM c) AS uv,
 (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS n FROM c GROUP BY quality)) AS u,
 (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS n FROM c GROUP BY toxic)) AS v,
 (SELECT sum(n) * (sum(n) - 1) / 2.0::DOUBLE FROM c) AS t)
SELECT round((uv - u * v / t) / ((u + v) / 2 - u * v / t), 6)::DOUBLE AS ari FROM s""")
def ps4(spark, sf):
    return similarity.adjusted_rand(j3(spark, sf)).select(r("ari").alias("ari"))
