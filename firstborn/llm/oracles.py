"""SQL for the operators that SQL can express, over the same tables."""

SPLIT = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DEDUP = f"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SPLIT}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
g AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT s.doc_id, len(s.g) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.g"""

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
w AS (SELECT doc_id, no, list_filter(regexp_split_to_array(line, '{SPLIT}'), lambda x: x <> '') AS ws FROM l),
s AS (SELECT doc_id, no, list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) > 0),
g AS (SELECT doc_id, no, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT DISTINCT doc_id, no FROM (SELECT b.doc_id, b.no FROM g a JOIN g b ON a.t = b.t AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.no < b.no)
  GROUP BY a.doc_id, a.no, b.doc_id, b.no, a.n, b.n HAVING count(*) * 9 >= (a.n + b.n) * 4))
SELECT l.doc_id, greatest(count(*) FILTER (p.no IS NULL), 1) AS n_lines_kept, (count(*) FILTER (p.no IS NOT NULL))::INTEGER AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (p.no IS NULL), '')) AS kept_md5
FROM l LEFT JOIN p ON p.doc_id = l.doc_id AND p.no = l.no GROUP BY l.doc_id"""

VECTOR_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x), n AS (SELECT x, count(*) AS k FROM e GROUP BY x)
SELECT v.vec_id, coalesce(n.k, 0) AS n_links, c.y AS component_id, c.y = v.vec_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id"""

HARD_NEGATIVES = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
