import random
import re
from collections import Counter
from math import log

import duckdb
import pytest

from firstborn.llm.license_scan import BASE, LEAST_SHARE, LOOKED_UP, RAREST, TEMPLATES, phrases, scan_licenses, template_index
from firstborn.llm.license_sql import LICENSES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts):
    """Every template is laid at every start of every file; no index."""
    files = [words_of(t) for t in texts]
    counts = Counter(w for ws in files for w in set(ws))
    rarity = lambda w: (counts[w], w)
    rare = [sorted(set(t.split()), key=rarity)[:RAREST] for _, t, _ in TEMPLATES]
    keys = {w for p in phrases() for w in p.split()}
    vocabulary = keys | {w for r in rare for w in r}
    out = []
    for ws in files:
        looked = set(sorted(vocabulary & set(ws), key=rarity)[:LOOKED_UP]) | keys
        stands = lambda p, s: s >= 0 and ws[s : s + len(p.split())] == p.split()  # noqa: B023, E731
        base = [(s, label) for p, label in BASE for s in range(len(ws)) if stands(p, s)]
        labels, score = {label for _, label in base}, 0.0
        for t, (label, text, wanted) in enumerate(TEMPLATES):
            body = text.split()
            weight = {w: log(1 + len(files) / (1 + counts[w])) for w in rare[t]}
            total = sum(weight.get(w, 0) for w in body)
            for s in range(-len(body), len(ws)):
                if all(stands(p, s + len(text[: text.index(p)].split())) for p in wanted):
                    there = [w for k, w in enumerate(body) if 0 <= s + k < len(ws) and ws[s + k] == w and w in looked]
                    share = sum(weight.get(w, 0) for w in there) / total
                    score = max(score, round(share, 6))
                    if round(share, 6) >= LEAST_SHARE:
                        labels.add(label)
        starts = [s for s, _ in base]
        out.append((len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 5)))
    return out


def notices():
    rng = random.Random(5)
    filler = [*"alpha beta gamma delta the of to in is mit license general public free software copy".split(), "größe", "x1"]
    rows = []
    for i in range(240):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randint(0, 30)))]
        if i % 3 == 0:
            words = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = rng.choice(filler)
            text = " ".join(words)
            parts.append(rng.choice([text, text.upper(), text.title().replace(" ", ", "), text.replace(" ", "\n* ")]))
            parts.append(" ".join(rng.choice(filler) for _ in range(rng.randint(0, 30))))
        rows.append((i, ".\n".join(parts)))
    rows.append((900, "MIT-License " * 3000 + "apache license"))
    rows.append((901, "License MIT general_public_license apache\x00license"))
    rows.append((902, "commons attribution noncommercial 4 0 international license"))  # begins before its first word
    return rows


def compared(rows, docs):
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 5)) for r in scan_licenses(docs).collect()]
    want = [(d, *facts) for (d, *_), facts in zip(rows, brute([r[1] for r in rows]), strict=True)]
    order = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    return sorted(got, key=order), sorted(want, key=order)


@pytest.mark.parametrize("odd", [False, True])
def test_scan(frame, odd_rows, odd):
    rows = odd_rows if odd else notices()
    got, want = compared(rows, frame(rows))
    assert got == want
    if not odd:
        labels = Counter(x for r in got for x in r[6].split(",") if x)
        assert {"mit", "apache", "apache-2.0", "gpl", "lgpl", "bsd", "isc", "mpl", "cc-by-nc"} <= set(labels)
        assert any(r[5] != r[6] for r in got) and all(set(r[5].split(",")) <= {"", *r[6].split(",")} for r in got)


def test_scan_of_nothing(frame):
    assert scan_licenses(frame([])).count() == 0
    (row,) = scan_licenses(frame([(None, "the MIT license")])).collect()
    assert (row.n_words, row.n_base, row.first_word, row.base_labels, row.labels) == (3, 1, 1, "mit", "mit")


def test_spans(frame):
    text = "x y. Licensed under the Apache License, Version 2.0. z"
    (row,) = scan_licenses(frame([(1, text)])).collect()
    assert [(s.label, s.start, s.share) for s in row.spans] == [("apache-2.0", 2, 1.0)] and row.score == 1.0


def test_index_takes_the_rarest_words():
    index = template_index(100, {"licensed": 90, "under": 80, "the": 99, "license": 50})
    apache = [w for t, w, _, _ in index.postings if TEMPLATES[t][0] == "apache-2.0"]
    assert set(apache) == set("licensed under the apache license version 2 0".split())
    long = {w for t, w, _, _ in index.postings if t == 1}
    assert len(long) == RAREST and not long & {"the"}
    assert index.words[-1] == "the" or "the" not in index.words


def test_sql_and_plan(spark, frame):
    con = duckdb.connect()
    docs = frame(notices()).toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM docs")
    want = con.execute(LICENSES)
    names = [d[0] for d in want.description]
    scanned = scan_licenses(frame(notices())).select(*names)
    key = lambda r: r[names.index("doc_id")]
    assert sorted(map(tuple, scanned.collect()), key=key) == sorted(want.fetchall(), key=key)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
