"""Posterior summaries, diagnostics, exact checks and grid posteriors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import draws as dr, exact, labels, likelihood as lk, similarity as sim
from ..functions.draws import hash_uniform
from ..plans import grids
from ..plans.parameter_moves import alpha_walk, stick_walk
from ..session import persist_reliably
from .base import (
    DR, DRAWS, EA, LENGTHS, STICKS, TD, TU, UA,
    draws, events, gaussian_marginal_sql, h52, lb, paths, query, r, table, turn_draws, turn_lengths, turns, users,
)
from .scores import GUMBEL, LB0, LBP, STICK_TERM

BURN = 5
KT = "kt AS (SELECT chain, iteration, count(DISTINCT cluster) AS num_clusters FROM d GROUP BY ALL)"
TR = f"{KT}, tr AS (SELECT chain, iteration, -(num_clusters % 5)::DOUBLE AS log_likelihood FROM kt)"


def trace(draw_rows):
    """A trace with ties: a coarse function of each draw's cluster count."""
    counts = dr.clusters_per_draw(draw_rows)
    return counts.select("chain", "iteration", (-(F.col("num_clusters") % 5)).cast("double").alias("log_likelihood"))


# --- aggregates over draws --------------------------------------------------


@query("a5_clusters_per_draw", f"""WITH {DR}, {KT} SELECT * FROM kt""")
def a5(spark, sf):
    return dr.clusters_per_draw(draws(spark, sf))


@query("a6_mean_clusters", f"""WITH {DR}, {KT} SELECT chain, round(avg(num_clusters), 6) AS plain, round(sum(iteration * num_clusters) / sum(iteration)::DOUBLE, 6) AS weighted FROM kt GROUP BY 1""")
def a6(spark, sf):
    counts = dr.clusters_per_draw(draws(spark, sf)).withColumn("w", F.col("iteration").cast("double"))
    plain = dr.mean_clusters(counts, ["chain"]).withColumnRenamed("mean_clusters", "plain")
    weighted = dr.mean_clusters(counts, ["chain"], "w").withColumnRenamed("mean_clusters", "weighted")
    return plain.join(weighted, "chain").select("chain", r("plain").alias("plain"), r("weighted").alias("weighted"))


SIG = f"""sg AS (SELECT series, iteration, list(cluster ORDER BY obs) AS z FROM td GROUP BY ALL),
fq AS (SELECT series, z, count(*) AS times, min(iteration) AS first_iteration, count(*) / {DRAWS}.0::DOUBLE AS frequency FROM sg GROUP BY ALL)"""


@query("a10_clustering_frequency", f"""WITH {TD}, {SIG} SELECT series, first_iteration, times, frequency FROM fq""")
def a10(spark, sf):
    sigs = dr.signatures(turn_draws(turns(spark, sf)), ["series", "iteration"])
    return dr.clustering_frequencies(sigs, ["series"]).select("series", "first_iteration", "times", "frequency")


SE = f"""bt AS (SELECT range AS b FROM range(0, 5)),
bp AS (SELECT fq.series, fq.z, fq.first_iteration, fq.frequency, bt.b, count(sg.iteration) / 4.0::DOUBLE AS p FROM fq CROSS JOIN bt
  LEFT JOIN sg ON sg.series = fq.series AND sg.z = fq.z AND (sg.iteration - 1) // 4 = bt.b GROUP BY ALL),
se AS (SELECT series, z, first_iteration, frequency, sqrt(4 / 4.0::DOUBLE * (sum(p * p) - sum(p) * sum(p) / 5)) / sqrt(20.0::DOUBLE) AS se FROM bp GROUP BY ALL)"""


def _intervals(spark, sf):
    rows = turn_draws(turns(spark, sf))
    sigs = dr.signatures(rows, ["series", "iteration"])
    targets = dr.clustering_frequencies(sigs, ["series"]).select("series", "sig_a", "sig_b", "first_iteration")
    return exact.clustering_intervals(rows, targets, ["series"], DRAWS)


@query("a11_batch_standard_error", f"""WITH {TD}, {SIG}, {SE} SELECT series, first_iteration, round(se, 6) AS se FROM se""")
def a11(spark, sf):
    return _intervals(spark, sf).select("series", "first_iteration", r("se").alias("se"))


@query("a12_probability_interval", f"""WITH {TD}, {SIG}, {SE} SELECT series, first_iteration, frequency, round(1.96 * se, 6) AS half_width FROM se""")
def a12(spark, sf):
    return _intervals(spark, sf).select("series", "first_iteration", "frequency", r("half_width").alias("half_width"))


@query("j5_matching_draws", f"""WITH {TD}, {SIG}, tz AS (SELECT series, list(cluster ORDER BY obs) AS z FROM ta GROUP BY 1)
SELECT tz.series, count(sg.iteration) AS times FROM tz LEFT JOIN sg USING (series, z) GROUP BY 1""")
def j5(spark, sf):
    rows = turns(spark, sf)
    target = dr.signatures(rows, ["series"])
    sigs = dr.signatures(turn_draws(rows), ["series", "iteration"])
    return target.join(sigs, ["series", "sig_a", "sig_b"], "left").groupBy("series").agg(
        F.count("iteration").alias("times")
    )


AP = f"ap AS (SELECT chain, obs, round(avg((obs = cluster)::INT), 6) AS arrival_prob FROM d WHERE iteration > {BURN} GROUP BY ALL)"


@query("a13_arrival_probability", f"""WITH {DR}, {AP} SELECT * FROM ap""")
def a13(spark, sf):
    kept = labels.keep_iterations(draws(spark, sf), BURN)
    return dr.arrival_probabilities(kept).withColumn("arrival_prob", r("arrival_prob"))


def _classified(spark, sf):
    kept = labels.keep_iterations(draws(spark, sf), BURN)
    return dr.classify_arrivals(dr.arrival_probabilities(kept), events(spark, sf))


TRUTH = "tb AS (SELECT user_id, min(obs) AS obs FROM ev GROUP BY 1), jt AS (SELECT ap.*, tb.obs IS NOT NULL AS true_arrival FROM ap LEFT JOIN tb USING (obs))"


@query("j6_arrival_truth", f"""WITH {DR}, {AP}, {TRUTH} SELECT * FROM jt""")
def j6(spark, sf):
    return _classified(spark, sf).select("chain", "obs", r("arrival_prob").alias("arrival_prob"), "true_arrival")


@query("a14_arrival_classes", f"""WITH {DR}, {AP}, {TRUTH} SELECT chain, CASE WHEN arrival_prob >= 0.5 AND true_arrival THEN 'TP' WHEN arrival_prob >= 0.5 THEN 'FP' WHEN true_arrival THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS observations FROM jt GROUP BY ALL""")
def a14(spark, sf):
    return _classified(spark, sf).groupBy("chain", "outcome").agg(F.count("*").alias("observations"))


@query("a15_size_distribution", f"""WITH {EA}, s AS (SELECT cluster, count(*) AS n_k FROM ea GROUP BY 1)
SELECT n_k, count(*) AS clusters FROM s GROUP BY 1""")
def a15(spark, sf):
    return dr.size_distribution(events(spark, sf))


@query("a15_size_histogram", f"""WITH {DR}, s AS (SELECT chain, iteration, cluster, count(*) AS n_k FROM d GROUP BY ALL),
b AS (SELECT chain, iteration, n_k, min(n_k) OVER w AS lo, (max(n_k) OVER w - min(n_k) OVER w) / 10.0::DOUBLE AS wd FROM s WINDOW w AS (PARTITION BY chain, iteration))
SELECT chain, iteration, CASE WHEN wd = 0 THEN 1 ELSE least(10, (floor((n_k - lo) / wd) + 1)::INTEGER) END AS bin, count(*) AS cnt FROM b GROUP BY ALL""")
def a15_histogram(spark, sf):
    sizes = labels.cluster_sizes(draws(spark, sf), ["chain", "iteration"])
    return dr.equal_width_histogram(sizes, "n_k", 10, ["chain", "iteration"])


@query("a15_mean_size", f"""WITH {DR}, s AS (SELECT chain, iteration, cluster, count(*) AS n_k FROM d GROUP BY ALL)
SELECT chain, iteration, round(avg(n_k), 2) AS mean_size FROM s GROUP BY ALL""")
def a15_mean(spark, sf):
    sizes = labels.cluster_sizes(draws(spark, sf), ["chain", "iteration"])
    return sizes.groupBy("chain", "iteration").agg(r(F.avg("n_k"), 2).alias("mean_size"))


ARI = """xc AS (SELECT chain, iteration, d.cluster AS u, ea.cluster AS v, count(*) AS n FROM d JOIN ea USING (obs) GROUP BY ALL),
uv AS (SELECT chain, iteration, sum(n * (n - 1) / 2.0::DOUBLE) AS uv, sum(n) AS t FROM xc GROUP BY ALL),
us2 AS (SELECT chain, iteration, sum(n * (n - 1) / 2.0::DOUBLE) AS u FROM (SELECT chain, iteration, u, sum(n) AS n FROM xc GROUP BY ALL) GROUP BY ALL),
vs2 AS (SELECT chain, iteration, sum(n * (n - 1) / 2.0::DOUBLE) AS v FROM (SELECT chain, iteration, v, sum(n) AS n FROM xc GROUP BY ALL) GROUP BY ALL),
ar AS (SELECT chain, iteration, (uv - u * v / (t * (t - 1) / 2.0::DOUBLE)) / ((u + v) / 2 - u * v / (t * (t - 1) / 2.0::DOUBLE)) AS ari FROM uv JOIN us2 USING (chain, iteration) JOIN vs2 USING (chain, iteration))"""
DA = DR + ", ea AS (SELECT obs, min(obs) OVER (PARTITION BY user_id) AS cluster FROM ev)"


@query("ps4_rand_over_draws", f"""WITH {DA}, {ARI} SELECT chain, iteration, round(ari, 6)::DOUBLE AS ari FROM ar""")
def ps4_draws(spark, sf):
    return sim.ari_over_draws(events(spark, sf), paths(spark, sf)).withColumn("ari", r("ari"))


@query("a16_mean_rand", f"""WITH {DA}, {ARI} SELECT chain, round(avg(ari), 3)::DOUBLE AS mean_ari, count(*) AS draws FROM ar WHERE iteration > {BURN} GROUP BY 1""")
def a16(spark, sf):
    kept = labels.keep_iterations(paths(spark, sf), BURN)
    return sim.ari_over_draws(events(spark, sf), kept).groupBy("chain").agg(
        r(F.avg("ari"), 3).alias("mean_ari"), F.count("*").alias("draws")
    )


# --- point estimates --------------------------------------------------------


@query("t1_map_clustering", f"""WITH {DR}, {TR}, best AS (SELECT chain, arg_max(iteration, log_likelihood * 1000 - iteration) AS iteration FROM tr WHERE iteration > {BURN} GROUP BY 1)
SELECT chain, iteration, obs, cluster FROM d JOIN best USING (chain, iteration)""")
def t1(spark, sf):
    rows = draws(spark, sf)
    return sim.take_draw(rows, sim.map_draw(trace(rows), BURN)).select("chain", "iteration", "obs", "cluster")


XC = f"""dk AS (SELECT * FROM d WHERE iteration > {BURN}),
xx AS (SELECT a.chain, a.iteration, b.iteration AS other, a.cluster AS u, b.cluster AS v, count(*) AS n FROM dk a JOIN dk b ON a.chain = b.chain AND a.obs = b.obs GROUP BY ALL)"""
BL = XC + """,
sz AS (SELECT chain, iteration, sum(n * (n - 1) / 2) AS p FROM xx WHERE iteration = other GROUP BY ALL),
bb AS (SELECT chain, iteration, other, sum(n * (n - 1) / 2) AS b FROM xx GROUP BY ALL),
bl AS (SELECT bb.chain, bb.iteration, avg(s.p + t.p - 2 * b) AS loss FROM bb JOIN sz s ON s.chain = bb.chain AND s.iteration = bb.iteration
  JOIN sz t ON t.chain = bb.chain AND t.iteration = bb.other GROUP BY ALL)"""


@query("ps2_binder_losses", f"""WITH {DR}, {BL} SELECT chain, iteration, round(loss, 3) AS loss FROM bl""")
def ps2_losses(spark, sf):
    kept = labels.keep_iterations(paths(spark, sf), BURN)
    return sim.binder_losses(kept).withColumn("loss", r("loss", 3))


@query("ps2_binder_estimate", f"""WITH {DR}, {BL}, k AS (SELECT chain, iteration, row_number() OVER (PARTITION BY chain ORDER BY round(loss, 9), iteration) AS rk FROM bl)
SELECT chain, iteration, obs, cluster FROM d JOIN k USING (chain, iteration) WHERE rk = 1""")
def ps2(spark, sf):
    kept = labels.keep_iterations(paths(spark, sf), BURN)
    return sim.take_draw(dr.unfold(kept), sim.best_draw(sim.binder_losses(kept))).select("chain", "iteration", "obs", "cluster")


VL = XC + """,
ov AS (SELECT a.chain, a.obs, a.iteration, avg(xx.n) AS o, max(xx.n) FILTER (xx.iteration = xx.other) AS s FROM dk a
  JOIN dk b ON a.chain = b.chain AND a.obs = b.obs JOIN xx ON xx.chain = a.chain AND xx.iteration = a.iteration AND xx.other = b.iteration AND xx.u = a.cluster AND xx.v = b.cluster GROUP BY ALL),
ms AS (SELECT chain, obs, avg(s) AS m FROM ov GROUP BY ALL),
vl AS (SELECT chain, iteration, avg(log2(s) + log2(m) - 2 * log2(o)) AS loss FROM ov JOIN ms USING (chain, obs) GROUP BY ALL)"""


@query("ps3_information_losses", f"""WITH {DR}, {VL} SELECT chain, iteration, round(loss, 6) AS loss FROM vl""")
def ps3_losses(spark, sf):
    kept = labels.keep_iterations(paths(spark, sf), BURN)
    return sim.information_losses(kept).withColumn("loss", r("loss"))


@query("ps3_information_estimate", f"""WITH {DR}, {VL}, k AS (SELECT chain, iteration, row_number() OVER (PARTITION BY chain ORDER BY round(loss, 9), iteration) AS rk FROM vl)
SELECT chain, iteration, obs, cluster FROM d JOIN k USING (chain, iteration) WHERE rk = 1""")
def ps3(spark, sf):
    kept = labels.keep_iterations(paths(spark, sf), BURN)
    return sim.take_draw(dr.unfold(kept), sim.best_draw(sim.information_losses(kept))).select("chain", "iteration", "obs", "cluster")


# --- co-occurrence ----------------------------------------------------------



def _neighbour_pairs(spark, sf):
    """Each event with its user's first event: a list as long as the events."""
    return events(spark, sf).filter(F.col("obs") > F.col("cluster")).select(
        F.col("cluster").alias("obs_a"), F.col("obs").alias("obs_b")
    )


def _order_pairs(spark, sf):
    """Each event with the event right before it."""
    rows = events(spark, sf)
    return rows.filter(F.col("obs") > 1).select((F.col("obs") - 1).alias("obs_a"), F.col("obs").alias("obs_b"))


@query("j1_co_assignment", f"""WITH {DR} SELECT a.chain, a.obs AS obs_a, b.obs AS obs_b, sum((a.cluster = b.cluster)::BIGINT)::BIGINT AS together, round(avg((a.cluster = b.cluster)::INT), 6) AS p
FROM d a JOIN d b ON a.chain = b.chain AND a.iteration = b.iteration AND a.obs = b.obs - 1 GROUP BY ALL""")
def j1(spark, sf):
    out = sim.pair_similarity(paths(spark, sf), _order_pairs(spark, sf))
    return out.select("chain", "obs_a", "obs_b", "together", r("p").alias("p"))


@query("j1_pair_counts", f"""WITH {DR}, s AS (SELECT chain, iteration, cluster, count(*) AS n FROM d GROUP BY ALL)
SELECT chain, iteration, sum(n * (n + 1) // 2)::BIGINT AS pairs, max(n) AS largest FROM s GROUP BY ALL""")
def j1_counts(spark, sf):
    return sim.pair_counts(draws(spark, sf))


AT = f"""pa AS (SELECT chain, obs, list(cluster ORDER BY iteration) AS z FROM d GROUP BY ALL),
am AS (SELECT chain, min(obs) AS atom, count(*) AS size, z FROM pa GROUP BY chain, z),
aw AS (SELECT chain, atom, size, unnest(range(1, {DRAWS + 1})) AS iteration, unnest(z) AS cluster FROM am)"""


@query("ps1_co_occurrence", f"""WITH {DR}, {AT} SELECT a.chain, a.atom AS atom_a, a.size AS size_a, b.atom AS atom_b, b.size AS size_b, round(count(*) / {DRAWS}.0::DOUBLE, 6) AS p
FROM aw a JOIN aw b ON a.chain = b.chain AND a.iteration = b.iteration AND a.cluster = b.cluster AND a.atom <= b.atom GROUP BY ALL""")
def ps1(spark, sf):
    return sim.co_occurrence(paths(spark, sf)).withColumn("p", r("p"))


@query("ps1_weighted_co_occurrence", f"""WITH {DR}, {AT} SELECT a.chain, a.atom AS atom_a, a.size AS size_a, b.atom AS atom_b, b.size AS size_b, round(sum(a.iteration) / 210.0::DOUBLE, 6) AS p
FROM aw a JOIN aw b ON a.chain = b.chain AND a.iteration = b.iteration AND a.cluster = b.cluster AND a.atom <= b.atom GROUP BY ALL""")
def ps1_weighted(spark, sf):
    rows = paths(spark, sf)
    return sim.co_occurrence(rows, weights=_by_iteration(dr.unfold(rows))).withColumn("p", r("p"))


def _by_iteration(rows):
    """Draws weighted by their number."""
    return dr.clusters_per_draw(rows).select("chain", "iteration", F.col("iteration").cast("double").alias("w"))


SIM = AT + f""",
sm AS (SELECT a.chain, a.atom AS atom_a, a.size AS size_a, b.atom AS atom_b, b.size AS size_b, count(*) / {DRAWS}.0::DOUBLE AS p
FROM aw a JOIN aw b ON a.chain = b.chain AND a.iteration = b.iteration AND a.cluster = b.cluster GROUP BY ALL)"""


@query("ps1_similar_atoms", f"""WITH {DR}, {SIM} SELECT chain, atom_a, size_a, atom_b, size_b, round(p, 6) AS p FROM sm WHERE atom_a <= atom_b AND round(p, 9) >= 0.6""")
def ps1_similar(spark, sf):
    return sim.similar_atoms(paths(spark, sf), 0.6).withColumn("p", r("p"))


@query("ps1_nearest_atoms", f"""WITH {DR}, {SIM}, rk AS (SELECT chain, atom_a AS atom, atom_b AS other, size_b AS size, p,
  row_number() OVER (PARTITION BY chain, atom_a ORDER BY round(p, 9) DESC, atom_b)::INTEGER AS rank FROM sm WHERE atom_a <> atom_b AND round(p, 9) >= 0.3)
SELECT chain, atom, other, size, round(p, 6) AS p, rank FROM rk WHERE rank <= 3""")
def ps1_nearest(spark, sf):
    return sim.nearest_atoms(paths(spark, sf), 3, 0.3).withColumn("p", r("p"))


@query("d5_weighted_heat_map", f"""WITH {DR}, {AT}, sm AS (SELECT a.chain, a.atom AS atom_a, a.size AS size_a, b.atom AS atom_b, b.size AS size_b, sum(a.iteration) / 210.0::DOUBLE AS p
FROM aw a JOIN aw b ON a.chain = b.chain AND a.iteration = b.iteration AND a.cluster = b.cluster AND a.atom <= b.atom GROUP BY ALL)
SELECT chain, atom_a, size_a, atom_b, size_b, round(p, 6) AS p FROM sm WHERE round(p, 9) >= 0.5""")
def d5_weighted(spark, sf):
    """Heat-map data of every chain, later draws weighing more, pale cells left out."""
    rows = paths(spark, sf)
    return sim.similar_atoms(rows, 0.5, weights=_by_iteration(dr.unfold(rows))).withColumn("p", r("p"))


@query("ps1_atom_members", f"""WITH {DR}, {AT} SELECT pa.chain, pa.obs, am.atom FROM pa JOIN am USING (chain, z)""")
def ps1_members(spark, sf):
    return sim.atom_members(paths(spark, sf))


@query("ps1_row_sums", f"""WITH {DR}, s AS (SELECT chain, iteration, cluster, count(*) AS n FROM d GROUP BY ALL)
SELECT chain, obs, round(avg(n), 6) AS mates FROM d JOIN s USING (chain, iteration, cluster) GROUP BY ALL""")
def ps1_rows(spark, sf):
    return sim.expected_cluster_mates(paths(spark, sf)).withColumn("mates", r("mates"))


@query("d5_similarity_of_clustering", f"""WITH {EA} SELECT cluster AS obs_a, obs AS obs_b, 1.0::DOUBLE AS p FROM ea WHERE obs > cluster""")
def d5(spark, sf):
    one = events(spark, sf).select(F.lit(1).alias("chain"), F.lit(1).alias("iteration"), "obs", "cluster")
    return sim.pair_similarity(one, _neighbour_pairs(spark, sf)).select("obs_a", "obs_b", "p")


# --- traces -----------------------------------------------------------------

STARTS = {1: "random", 2: "all same cluster"}


@query("d2_log_likelihood_trace", f"""WITH {DR}, {TR} SELECT chain, iteration, log_likelihood, CASE chain WHEN 1 THEN 'random' ELSE 'all same cluster' END AS start FROM tr""")
def d2(spark, sf):
    names = F.create_map(*[F.lit(v) for item in STARTS.items() for v in item])
    return trace(draws(spark, sf)).withColumn("start", names[F.col("chain")])


@query("d3_cluster_count_trace", f"""WITH {DR}, {KT} SELECT kt.*, (SELECT count(DISTINCT user_id) FROM ev) AS true_number FROM kt""")
def d3(spark, sf):
    counts = dr.clusters_per_draw(draws(spark, sf))
    base = events(spark, sf)
    true = base.agg(F.sum((F.col("obs") == F.col("cluster")).cast("bigint")).alias("true_number"))
    return counts.join(F.broadcast(true), F.lit(True)).select("chain", "iteration", "num_clusters", "true_number")


@query("d4_parameter_trace", f"""WITH {DR}, s AS (SELECT chain, iteration, count(DISTINCT cluster) AS k, count(*) AS n FROM d GROUP BY ALL)
SELECT chain, iteration, 'arrival_a' AS parameter, 1.5::DOUBLE + k - 1 AS value FROM s UNION ALL SELECT chain, iteration, 'arrival_b', 4.0::DOUBLE + n - k FROM s""")
def d4(spark, sf):
    sizes = labels.cluster_sizes(draws(spark, sf), ["chain", "iteration"])
    out = grids.arrival_moments(sizes, STICKS, ["chain", "iteration"])
    return dr.long_trace(out, ["arrival_a", "arrival_b"])


# --- exact posteriors -------------------------------------------------------

LV = (0.25, 5.0, 1.0)
PARTS = """nn AS (SELECT series, count(*) AS n FROM ta GROUP BY 1),
parts AS (SELECT series, n, 1::BIGINT AS i, [1::BIGINT] AS labels FROM nn WHERE n <= 12
  UNION ALL SELECT series, n, i + 1, list_append(labels, c.c) FROM parts, LATERAL (SELECT unnest(list_append(list_distinct(labels), i + 1)) AS c) c WHERE i < n),
pz AS (SELECT series, labels, NULL::INTEGER AS candidate FROM parts WHERE i = n)"""
# Series too long to enumerate: their roles' clustering and their distinct draws.
CANDIDATES = """cz AS (SELECT series, z AS labels, min(iteration)::INTEGER AS candidate FROM (SELECT series, iteration, list(cluster ORDER BY obs) AS z FROM
    (SELECT series, 0 AS iteration, obs, cluster FROM ta UNION ALL SELECT series, iteration, obs, cluster FROM td) GROUP BY ALL)
  WHERE series IN (SELECT series FROM nn WHERE n > 12) GROUP BY ALL)"""
SCORED = f"""{CANDIDATES}, pc AS (SELECT * FROM pz UNION ALL SELECT series, labels, candidate FROM cz),
pl AS (SELECT series, labels, unnest(labels) AS cluster, generate_subscripts(labels, 1) AS obs FROM pc),
pg AS (SELECT series, labels, pl.cluster, count(*) AS n_k, sum(x) AS s, sum(x * x) AS q FROM pl JOIN ta USING (series, obs) GROUP BY ALL),
ph AS (SELECT *, (coalesce(sum(n_k) OVER (PARTITION BY series, labels ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (cluster - 1))::BIGINT AS comp FROM pg),
pj AS (SELECT series, labels, sum({gaussian_marginal_sql('n_k', 's', 'q', *LV)}) + sum({STICK_TERM}) + {lb('1.5::DOUBLE + count(*) - 1', '4.0::DOUBLE + sum(n_k)::DOUBLE - count(*)')} - {LBP} AS js FROM ph GROUP BY ALL),
pm AS (SELECT *, js - max(js) OVER (PARTITION BY series) AS above FROM pj),
px AS (SELECT series, labels, candidate, CASE WHEN candidate IS NULL THEN array_to_string(labels, '-') END AS label, js, count(*) OVER w AS candidates,
  exp(above) / sum(exp(above)) OVER w AS probability FROM pm JOIN pc USING (series, labels) WINDOW w AS (PARTITION BY series))"""


def _lengths(spark, sf):
    rows = turn_lengths(turns(spark, sf))
    series = rows.groupBy("series").agg(F.count("*").alias("n"))
    return rows, series, series.agg(F.max("n")).first()[0]


def _partitions(spark, sf):
    rows, series, longest = _lengths(spark, sf)
    return rows, series, exact.all_partitions(series, ["series"], longest)


NAMES = ["series", "labels", "candidate", "candidates"]


def _enumerated(spark, sf):
    """Every clustering of the series short enough to enumerate, scored."""
    rows, series, longest = _lengths(spark, sf)
    scored = exact.enumerated_scores(exact.short_series(rows, ["series"]), LENGTHS, STICKS, ["series"], longest)
    return rows, series, exact.candidate_posterior(scored, ["series"])


def _candidates(rows, series, sampled):
    """Of longer series the distinct draws and the clustering by role; their rows and their scores."""
    long = exact.too_long(series, ["series"]).select("series")
    given = rows.select("series", "obs", "cluster").join(long, "series", "left_semi")
    found = persist_reliably(exact.candidate_clusterings(sampled.join(long, "series", "left_semi"), ["series"], given))
    pairs = found.join(rows.drop("cluster"), ["series", "obs"])
    scored = lk.joint_score(pairs, LENGTHS, STICKS, ["series", "candidate"], levels=1)
    return found, exact.candidate_posterior(scored, ["series"])


def _named(short, long):
    """Enumerated clusterings by their labels, candidates by their number."""
    one = short.withColumns({"labels": label_text(), "candidate": F.lit(None).cast("int")})
    two = long.withColumn("labels", F.lit(None).cast("string"))
    columns = [c for c in one.columns if c in two.columns]
    return one.select(*columns).unionByName(two.select(*columns))


def label_text():
    return F.concat_ws("-", F.transform(exact.code_labels(), lambda v: v.cast("string"))).alias("labels")



@query("u2_all_partitions", f"""WITH RECURSIVE {TU}, {PARTS} SELECT series, array_to_string(labels, '-') AS labels FROM pz
UNION ALL SELECT series, NULL FROM nn WHERE n > 12""")
def u2(spark, sf):
    """A series too long to enumerate is one row without labels."""
    _, series, parts = _partitions(spark, sf)
    left_out = exact.too_long(series, ["series"]).select("series", F.lit(None).cast("string").alias("labels"))
    return parts.select("series", label_text()).unionByName(left_out)


@query("m20_exact_posterior", f"""WITH RECURSIVE {TD}, {PARTS}, {SCORED} SELECT series, label AS labels, candidate, candidates, round(js, 5) AS joint_score, round(probability, 7) AS probability FROM px""")
def m20(spark, sf):
    """All clusterings of short conversations; of longer ones the candidates, normalised over their set."""
    rows, series, short = _enumerated(spark, sf)
    _, long = _candidates(rows, series, turn_draws(rows))
    return _named(short, long).select(*NAMES, r("joint_score", 5).alias("joint_score"), r("probability", 7).alias("probability"))


@query("m21_validation_table", f"""WITH RECURSIVE {TD}, {PARTS}, {SCORED}, {SIG}, {SE}
SELECT px.series, px.label AS labels, candidate, candidates, round(probability, 7) AS probability, coalesce(frequency, 0) AS frequency, round(coalesce(1.96 * se, 0), 6) AS half_width,
coalesce(abs(probability - frequency) <= 1.96 * se, FALSE) AS covered FROM px LEFT JOIN se ON se.series = px.series AND se.z = px.labels""")
def m21(spark, sf):
    rows, series, short = _enumerated(spark, sf)
    sampled = turn_draws(rows)
    found, long = _candidates(rows, series, sampled)
    tables = [exact.validation_table(short, sampled, ["series"], DRAWS), exact.validation_table(long, sampled, ["series"], DRAWS, found)]
    return _named(*tables).select(
        *NAMES, r("probability", 7).alias("probability"), "frequency", r("half_width").alias("half_width"), "covered"
    )


# --- grid posteriors --------------------------------------------------------

DRAW = ["chain", "iteration"]
SHAPE = "sh AS (SELECT chain, iteration, count(*) AS n, count(DISTINCT cluster) AS k FROM d GROUP BY ALL)"
AG = f"""{SHAPE}, ag AS (SELECT chain, iteration, g, n, k, exp(ln(0.001::DOUBLE) + (ln(n) - ln(0.001::DOUBLE)) * ((g - 0.5::DOUBLE) / 64.0::DOUBLE)) AS alpha FROM sh, range(1, 65) t(g)),
aw AS (SELECT chain, iteration, g, alpha, k * ln(alpha) + lgamma(alpha) - lgamma(n + alpha) + ln(alpha) AS lw FROM ag)"""


@query("g4_alpha_posterior", f"""WITH {DR}, {AG}, m AS (SELECT *, max(lw) OVER (PARTITION BY chain, iteration) AS top FROM aw)
SELECT chain, iteration, round(sum(alpha * exp(lw - top)) / sum(exp(lw - top)), 5) AS mean_alpha, arg_max(g, lw + {GUMBEL.format(h=h52("'a:' || chain || ':' || iteration || ':' || g"))})::INTEGER AS drawn FROM m GROUP BY ALL""")
def g4(spark, sf):
    from ..session import persist_reliably

    sizes = labels.cluster_sizes(draws(spark, sf), DRAW)
    grid = persist_reliably(grids.alpha_grid(sizes, DRAW))
    mean = grid.groupBy(*DRAW).agg(r(F.sum(F.col("alpha") * F.col("probability")), 5).alias("mean_alpha"))
    drawn = grids.grid_draw(grid, DRAW, "g", "a").select(*DRAW, F.col("g").alias("drawn"))
    return mean.join(drawn, DRAW)


SG = f"""{SHAPE}, sz AS (SELECT chain, iteration, cluster, count(*) AS n_k FROM d GROUP BY ALL),
sc AS (SELECT *, (coalesce(sum(n_k) OVER (PARTITION BY chain, iteration ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (cluster - 1))::BIGINT AS comp FROM sz),
sg AS (SELECT chain, iteration, cell, exp(ln(0.1::DOUBLE) + (ln(n) - ln(0.1::DOUBLE)) * ((cell // 8 + 0.5::DOUBLE) / 8)) AS a,
  exp(ln(0.1::DOUBLE) + (ln(n) - ln(0.1::DOUBLE)) * ((cell % 8 + 0.5::DOUBLE) / 8)) AS b FROM sh, range(0, 64) t(cell)),
sw AS (SELECT chain, iteration, cell, a, b, ln(a) + ln(b) + sum({lb('a + n_k - 1', 'b + comp')} - {lb('a', 'b')}) AS lw FROM sg JOIN sc USING (chain, iteration) WHERE cluster > 1 GROUP BY chain, iteration, cell, a, b)"""


@query("g5_stick_posterior", f"""WITH {DR}, {SG}, m AS (SELECT *, max(lw) OVER (PARTITION BY chain, iteration) AS top FROM sw)
SELECT chain, iteration, round(sum(a * exp(lw - top)) / sum(exp(lw - top)), 4) AS mean_a, round(sum(b * exp(lw - top)) / sum(exp(lw - top)), 4) AS mean_b,
arg_max(cell, lw + {GUMBEL.format(h=h52("'s:' || chain || ':' || iteration || ':' || cell"))})::INTEGER AS drawn FROM m GROUP BY ALL""")
def g5(spark, sf):
    from ..session import persist_reliably

    sizes = labels.cluster_sizes(draws(spark, sf), DRAW)
    grid = persist_reliably(grids.stick_grid(sizes, DRAW))
    p = F.col("probability")
    mean = grid.groupBy(*DRAW).agg(
        r(F.sum(F.col("psi_a") * p), 4).alias("mean_a"), r(F.sum(F.col("psi_b") * p), 4).alias("mean_b")
    )
    drawn = grids.grid_draw(grid, DRAW, "cell", "s").select(*DRAW, F.col("cell").alias("drawn"))
    return mean.join(drawn, DRAW)


def _step_uniform(tag, *step):
    return hash_uniform(F.concat_ws(":", F.lit(tag), "chain", "iteration", *step))


def step_uniform(tag: str, *step: str) -> str:
    key = " || ':' || ".join([f"'{tag}'", "chain", "iteration", *step])
    return f"(greatest({h52(key)}, 0.5::DOUBLE) / {2**52}.0::DOUBLE)"


def step_normal(tag: str, *step: str) -> str:
    return f"(sqrt(-2 * ln({step_uniform(tag + 'r', *step)})) * cos(2 * pi() * {step_uniform(tag + 't', *step)}))"


@query("g4_alpha_steps", f"""WITH RECURSIVE {DR}, {SHAPE}, wk AS (SELECT chain, iteration, n, k, 0 AS j, ln(least(1.0::DOUBLE, n * 0.999::DOUBLE)) AS t FROM sh
UNION ALL SELECT chain, iteration, n, k, j, CASE WHEN "to" < ln(n) AND ln({step_uniform('accept', 'j')}) < k * "to" + lgamma(exp("to") + 1) - lgamma(n + exp("to")) - (k * t + lgamma(exp(t) + 1) - lgamma(n + exp(t))) THEN "to" ELSE t END
  FROM (SELECT *, t + 2.4::DOUBLE / sqrt(k) * {step_normal('walk', 'j')} AS "to" FROM (SELECT chain, iteration, n, k, j + 1 AS j, t FROM wk WHERE j < 12)))
SELECT chain, iteration, round(exp(t), 5) AS alpha FROM wk WHERE j = 12""")
def g4_steps(spark, sf):
    """alpha of every draw after twelve exact steps from 1, on the whole of (0, n)."""
    shape = labels.cluster_sizes(draws(spark, sf), DRAW).groupBy(*DRAW).agg(F.sum("n_k").alias("n"), F.count("*").alias("k"))
    return shape.select(*DRAW, r(alpha_walk(F.col("n"), F.col("k"), F.lit(1.0), _step_uniform, 12), 5).alias("alpha"))


@query("g5_stick_step", f"""WITH {DR}, {SG}, st AS (SELECT chain, iteration, n, k, exp(2.4::DOUBLE / sqrt(2.0::DOUBLE) / sqrt(greatest(k - 1, 1)) * {step_normal('a')}) AS a,
  exp(2.4::DOUBLE / sqrt(2.0::DOUBLE) / sqrt(greatest(k - 1, 1)) * {step_normal('b')}) AS b FROM sh),
sv AS (SELECT chain, iteration, a, b, n, coalesce(sum({lb('a + n_k - 1', 'b + comp')} - {lb('a', 'b')} - {lb('n_k::DOUBLE', '1.0::DOUBLE + comp')} + {lb('1.0::DOUBLE', '1.0::DOUBLE')}) FILTER (cluster > 1), 0) + ln(a) + ln(b) AS ratio
  FROM st JOIN sc USING (chain, iteration) GROUP BY chain, iteration, a, b, n)
SELECT chain, iteration, a < n AND b < n AND ln({step_uniform('accept')}) < ratio AS moved, round(CASE WHEN a < n AND b < n AND ln({step_uniform('accept')}) < ratio THEN a ELSE 1 END, 5) AS psi_a,
round(CASE WHEN a < n AND b < n AND ln({step_uniform('accept')}) < ratio THEN b ELSE 1 END, 5) AS psi_b FROM sv""")
def g5_step(spark, sf):
    """The stick parameters of every draw after one exact step from (1, 1)."""
    sizes = persist_reliably(labels.cluster_sizes(draws(spark, sf), DRAW))
    shape = sizes.groupBy(*DRAW).agg(F.sum("n_k").alias("n"), F.count("*").alias("k"))
    shape = shape.withColumns({"psi_a": F.lit(1.0), "psi_b": F.lit(1.0)})
    out = stick_walk(shape, sizes, DRAW, _step_uniform)
    return out.select(*DRAW, (F.col("psi_a") != 1).alias("moved"), r("psi_a", 5).alias("psi_a"), r("psi_b", 5).alias("psi_b"))


@query("g6_arrival_posterior", f"""WITH {DR}, {SHAPE}, ab AS (SELECT chain, iteration, n, k, 1.5::DOUBLE + k - 1 AS a, 4.0::DOUBLE + n - k AS b FROM sh),
pg AS (SELECT chain, iteration, g, (a - 1) * ln((g - 0.5::DOUBLE) / 64) + (b - 1) * ln(1 - (g - 0.5::DOUBLE) / 64) AS lw FROM ab, range(1, 65) t(g)),
dw AS (SELECT chain, iteration, arg_max(g, lw + {GUMBEL.format(h=h52("'p:' || chain || ':' || iteration || ':' || g"))})::INTEGER AS drawn FROM pg GROUP BY ALL)
SELECT chain, iteration, n, k, round(a / (a + b), 8) AS phi_mean, round(sqrt(a * b / ((a + b) ^ 2 * (a + b + 1))), 8) AS phi_sd, drawn FROM ab JOIN dw USING (chain, iteration)""")
def g6(spark, sf):
    sizes = labels.cluster_sizes(draws(spark, sf), DRAW)
    exact_part = grids.arrival_moments(sizes, STICKS, DRAW)
    drawn = grids.grid_draw(grids.arrival_grid(sizes, STICKS, DRAW), DRAW, "g", "p")
    return exact_part.join(drawn, DRAW).select(
        *DRAW, "n", "k", r("phi_mean", 8).alias("phi_mean"), r("phi_sd", 8).alias("phi_sd"), F.col("g").alias("drawn")
    )
