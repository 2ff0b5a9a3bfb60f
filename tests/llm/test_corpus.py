import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firstborn.llm.mixing import mix, mixed_documents, permute, taken_words, word_sizes
from firstborn.llm.outliers import quality_rules, text_statistics
from firstborn.llm.quality import AttentionModel, FEATURES, encode_passages, fit_attention, fit_quality, held_out, keep_quality, score_quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, stop at the limit, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def mixed_rows():
    rng = random.Random(7)
    rows = []
    for d in range(400):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "é", "Z", None, "tiny"] if d > 300 else ["a", "b"])
        rows.append((d, " ".join("w" for _ in range(rng.choice([0, 1, 5, 60, 300]))), "en", source))
    return [*rows, (7, None, "en", "only empty"), (8, "x y z", "en", "a"), (8, "x y z", "en", "a")]


def test_mix(frame):
    rows = mixed_rows()
    sizes = word_sizes(frame(rows))
    got = taken_words(*mix(sizes, block_words=16, shard_slots=64)).collect()
    assert len(got) == len(rows)
    by_source, targets, taken = defaultdict(int), {}, defaultdict(int)
    for d, t, _, s in rows:
        by_source[s] += len((t or "").split())
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == by_source[r.source]
        targets[r.source] = r.target
        taken[r.source] += r.taken
    want = filled(by_source)
    for s, t in targets.items():
        assert math.isclose(t, want[s], abs_tol=1e-6) and abs(taken[s] - t) <= 1
    again = taken_words(*mix(word_sizes(frame(rows[::-1])), block_words=16, shard_slots=64)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_documents(frame):
    rows = [(d, t and t.replace("w", f"w{d}"), lang, s) for d, t, lang, s in mixed_rows()]
    rows.append((999, "  two  words\n", "en", "a"))
    out = mixed_documents(frame(rows), block_words=16, shard_slots=64)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = out.collect()
    texts = {d: t for d, t, *_ in rows if d not in (7, 8)}
    words = Counter()
    for r in got:
        if r.doc_id in texts:
            assert r.text in texts[r.doc_id]
            words[r.doc_id] += len(r.text.split())
        assert r.text is None or r.n_chars == len(r.text)
    taken = {r.doc_id: r.taken for r in taken_words(*mix(word_sizes(frame(rows)), block_words=16, shard_slots=64)).collect()}
    assert all(words[d] == taken[d] for d in texts)
    empty = [d for d, t, *_ in rows if not (t or "").split()]
    assert Counter(r.doc_id for r in got if not (r.text or "").split()) == Counter(empty)


def test_mix_of_nothing(frame):
    assert taken_words(*mix(word_sizes(frame([])))).count() == 0
    assert taken_words(*mix(word_sizes(frame([(1, None), (2, " ")])))).count() == 2
    assert mixed_documents(frame([])).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_permutation(size):
    places = permute(np.arange(size), size, 12345)
    assert sorted(places) == list(range(size))
    assert (permute(places, size, 12345, inverse=True) == np.arange(size)).all()


def test_statistics(frame, odd_rows):
    rng = random.Random(8)
    rows = list(odd_rows)
    for d in range(100, 160):
        words = [rng.choice("abcd") * rng.randint(1, 2) + rng.choice(["", "#", "é", "$%"]) for _ in range(rng.randint(0, 30))]
        rows.append((d, "".join(w + rng.choice([" ", "\n", "\n\n", "  "]) for w in words)))
    rows.append((500, "p q r s " * 17_000))
    got = sorted(
        (-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        for r in text_statistics(frame(rows)).collect()
    )
    want = []
    for d, t, *_ in rows:
        words = WORDS.findall(t or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want.append(
            (-1 if d is None else d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        )
    assert got == sorted(want)


def test_outliers(frame, odd_rows):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows = list(odd_rows)
    for d in range(1000, 1400):
        words = [word() for _ in range(rng.randint(60, 200))]
        if d % 10 == 0:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        rows.append((d, " ".join(words), rng.choice(["en", None]), "hot" if d % 3 else None))
    got = {r.doc_id: r for r in quality_rules(frame(rows), fewest=30).collect()}
    for d in range(1000, 1400):
        assert got[d].kept == (d % 10 != 0), d
    assert got[1].base_failed and got[1].n_words == 0 and not got[1].kept
    assert quality_rules(frame([])).count() == 0
    assert quality_rules(frame([(1, None), (2, "a b")])).count() == 2


def test_outliers_of_rare_groups(frame):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))

    def text(bad=False):
        return " ".join(word() + "###" * bad for _ in range(rng.randint(60, 200)))

    rows = [(d, text(), "fr", "web") for d in range(300)] + [(d, text(), None, "web") for d in range(300, 500)]
    # A rare source of a large language, and rare languages: alone, in twos and in fives.
    rare = [("fr", "alone", 1), ("fr", None, 2), ("fr", "five", 5), ("it", "web", 1), ("pt", None, 2), (None, "five", 5)]
    bad = {1000 + 100 * i + k: (lang, source) for i, (lang, source, n) in enumerate(rare) for k in range(n)}
    rows += [(d, text(True), *group) for d, group in bad.items()]
    rows += [(2000, text(), "fr", "other"), (2001, text(), "xx", "other")]
    got = {r.doc_id: r for r in quality_rules(frame(rows)).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    assert [d for d in got if got[d].kept == (d in bad)] == []


def labelled():
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for d in range(600):
        good = d % 3 > 0
        words = [word() for _ in range(rng.randint(5, 600))]
        if not good:
            half = len(words) // 2
            words[half:] = [w.upper() + "!!" for w in words[half:]]
        rows.append((d, " ".join(words)))
        labels.append((d, int(good), 0))
    return rows, labels


def test_quality(spark, frame, odd_rows):
    rows, labels = labelled()
    labels += [(None, 1, 0), (3, None, 0), (77777, 1, 1), (1, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = frame([*rows, *((None if d is None else d + 5000, t, *r) for d, t, *r in odd_rows)])
    model = fit_quality(docs, marks, steps=150)
    assert isinstance(model, AttentionModel)
    scores = score_quality(docs, model).withColumn("held", held_out("doc_id")).collect()
    assert len(scores) == len(rows) + len(odd_rows) and all(0 <= r.score <= 1 for r in scores)
    hidden = [r for r in scores if r.held and r.doc_id is not None and r.doc_id < 5000]
    assert len(hidden) > 60 and np.mean([(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in hidden]) > 0.95
    again = fit_quality(docs.repartition(5), marks, steps=150)
    assert np.allclose(model.out, again.out)
    kept = keep_quality(docs, model, 0.3, ("doc_id", "text", "lang"))
    assert kept.count() == sum(r.score >= 0.3 for r in scores) and kept.columns == ["doc_id", "text", "lang"]
    assert score_quality(frame([]), model).count() == 0
    assert fit_quality(docs, marks.limit(0)) == 0.5
    assert fit_quality(docs, marks.filter("quality = 1")) == 1.0
    assert {r.score for r in score_quality(frame(odd_rows), 0.5).collect()} == {0.5}


def test_attention_gradients():
    rng = np.random.default_rng(11)
    per_text = np.array([1, 3, 2, 5])
    x, y = rng.normal(size=(11, FEATURES)), np.array([0.0, 1.0, 1.0, 0.0])
    model = fit_attention(x, per_text, y, steps=2, hidden=4)
    weight = np.full(4, 0.25)

    def loss():
        s = model.score(x, per_text)
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    for name, grad in model.gradients(x, per_text, y, weight).items():
        p = getattr(model, name)
        at = tuple(rng.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = loss()
        p[at] = old - 1e-6
        down = loss()
        p[at] = old
        assert math.isclose((up - down) / 2e-6, grad[at], rel_tol=1e-4, abs_tol=1e-8), name


def test_passages_cover_the_text():
    texts = [b"", b"Abc def!! 12", b"x" * 2500, "日本 ÉÉ".encode()]
    x, per_text = encode_passages(texts)
    assert per_text.tolist() == [1, 1, 3, 1] and x.shape == (6, FEATURES) and np.isfinite(x).all()


def test_pipeline(spark, tmp_path, frame, odd_rows):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    read = lambda i: spark.read.parquet(f"{tmp_path}/{i}")
    good = labels.filter("quality = 1").join(read(0), "doc_id", "left_semi").count()
    assert good >= 0.97 * labels.filter("quality = 1").count()
    assert read(2).count() == read(2).select("doc_id").distinct().count() <= read(1).count() <= read(0).count()
    assert docs.count() == read(3).count() and docs.filter(F.col("n_pieces") != F.size("ids")).count() == 0
    for stage in (f for _, f in corpus_pipeline.STAGES):
        stage(spark, frame(odd_rows), sf).count()
        assert stage(spark, frame([]), sf).count() == 0


def test_quality_stage_holds_and_returns_slices_of_a_batch():
    import pyarrow as pa

    from firstborn.llm import quality

    texts = [None, "", *["word " * 8_000] * 20, "é" * 10]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = list(quality.passing(iter([batch]), 0.5, 0.3))
    assert [i for part in out for i in part.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert [t for part in out for t in part.column("text").to_pylist()] == texts
    assert max(sum(len(t or "") for t in part.column("text").to_pylist()) for part in out) < quality.SLICE + 40_001
    assert sum(len(part) for part in quality.passing(iter([batch]), 0.2, 0.3)) == 0
