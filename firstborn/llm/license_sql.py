"""SQL of the licence scan, over the same fixed templates."""

from __future__ import annotations

from .license_scan import BASE, LEAST_SHARE, LOOKED_UP, RAREST, TEMPLATES, UPPER, phrases


def _values(rows) -> str:
    quoted = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


_NUMBER = {p: i for i, p in enumerate(phrases())}
_PHRASES = [(i, w, k, len(p.split())) for p, i in _NUMBER.items() for k, w in enumerate(p.split())]
_TEXTS = [(t, w, k) for t, (_, text, _) in enumerate(TEMPLATES) for k, w in enumerate(text.split())]
_KEYS = [
    (t, _NUMBER[p], len(text[: f" {text} ".index(f" {p} ")].split()), len(keys)) for t, (_, text, keys) in enumerate(TEMPLATES) for p in keys
]

LICENSES = f"""WITH phrase(p, word, o, len) AS ({_values(_PHRASES)}), body(t, word, o) AS ({_values(_TEXTS)}),
need(t, p, o, wanted) AS ({_values(_KEYS)}), label(t, label) AS ({_values([(t, x[0]) for t, x in enumerate(TEMPLATES)])}),
base(p, label) AS ({_values([(i, x[1]) for i, x in enumerate(BASE)])}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
df AS (SELECT v.word, count(DISTINCT w.r) AS n FROM (SELECT word FROM body UNION SELECT word FROM phrase) v LEFT JOIN w USING (word) GROUP BY v.word),
rare AS (SELECT t, word, ln(1 + (SELECT count(*) FROM d) / (1 + n)) AS weight FROM (SELECT DISTINCT t, word FROM body) JOIN df USING (word)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, word) <= {RAREST}),
post AS (SELECT t, word, o, weight / sum(weight) OVER (PARTITION BY t) AS weight FROM body JOIN rare USING (t, word)),
own AS (SELECT r, word FROM (SELECT DISTINCT r, word FROM w) JOIN df USING (word) WHERE word IN (SELECT word FROM rare UNION SELECT word FROM phrase)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY n, word) <= {LOOKED_UP} OR word IN (SELECT word FROM phrase)),
hit AS (SELECT r, word, i FROM w JOIN own USING (r, word)),
place AS (SELECT r, p, i - o AS s FROM hit JOIN phrase USING (word) GROUP BY r, p, i - o, len HAVING count(*) = len),
share AS (SELECT r, t, i - o AS s, sum(weight) AS share FROM hit JOIN post USING (word) GROUP BY r, t, i - o),
stand AS (SELECT r, t, s - o AS s FROM place JOIN need USING (p) GROUP BY r, t, s - o, wanted HAVING count(*) = wanted),
best AS (SELECT r, t, max(round(share, 6)) AS share FROM share JOIN stand USING (r, t, s) GROUP BY r, t),
b AS (SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT label) AS l FROM place JOIN base USING (p) GROUP BY r),
m AS (SELECT r, max(share) AS score, list(DISTINCT label) FILTER (share >= {LEAST_SHARE}) AS l FROM best JOIN label USING (t) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(b.l, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(m.l, [])))), ',') AS labels,
  least(coalesce(score, 0), 1)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""
