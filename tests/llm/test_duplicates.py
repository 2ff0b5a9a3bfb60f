import hashlib
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from firstborn.llm.components import components
from firstborn.llm.line_dedup import BUCKET_BITS, dedup_lines, line_shingles, ordered_tokens
from firstborn.llm.near_dedup import keep_first_of_group, most_apart, near_duplicates, set_bits, unsettled
from firstborn.llm.suffix_dedup import repeated_spans, suffix_ranks, window_owners
from firstborn.llm.vector_dedup import link_vectors
from firstborn.session import persist_reliably

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORDS.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def closed(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def copies(seed, n=260):
    """One original with many exact and near copies, chains of edits, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    quoted = " ".join(word() for _ in range(60))
    rows, chain = [], list(base)
    for i in range(n):
        kind = i % 5
        words = list(base)
        if kind == 1:
            words[rng.randrange(120)] = word()
        elif kind == 2:
            chain[rng.randrange(120)] = word()
            words = list(chain)
        elif kind == 3:
            words = [word() for _ in range(40)] + quoted.split()
        elif kind == 4:
            words = [word() for _ in range(rng.randint(1, 200))]
        rows.append((i + 10, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(frame, odd_rows, seed):
    rows = [*odd_rows, *((d + 100, t) for d, t in copies(seed))]
    got = near_duplicates(frame(rows)).collect()
    sets = [shingles(t) for _, t, *_ in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    root = closed(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        d = rows[i][0]
        if d is not None:
            least[r] = min(d, least.get(r, d))
    order = lambda v: tuple(-1 if x is None else x for x in v)
    want = sorted(((rows[i][0], len(sets[i]), least.get(r), rows[i][0] == least.get(r)) for i, r in root.items()), key=order)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=order) == want
    kept = sorted(r.doc_id for r in keep_first_of_group(frame(rows)).collect() if r.doc_id is not None)
    blank = sorted(rows[i][0] for i in range(len(rows)) if not sets[i])
    assert kept == sorted([*blank, *{least[r] for i, r in root.items() if sets[i] and r in least}])


@pytest.mark.parametrize("ratio", [(4, 5), (7, 10), (1, 2)])
def test_near_duplicates_at_other_ratios(frame, ratio):
    """Pairs about the threshold, small and of more than 256 shingles, each with words of its own."""
    part, whole = ratio
    rng = random.Random(whole)
    rows, want = [], {}
    for i in range(120):
        word = iter(f"p{i}w{k}" for k in range(10_000)).__next__
        common = rng.randint(30, 150) if i % 3 == 0 else rng.randint(250, 900)
        apart = common * (whole - part) // part + (0, 0, -1, 1, 3)[i % 5]
        first = rng.choice([0, apart // 2, rng.randint(0, apart)])
        head = [word() for _ in range(common + 4)]
        rows += [(2 * i + j, " ".join([*head, *(word() for _ in range(n))])) for j, n in enumerate((first, apart - first))]
        want[2 * i] = 2 * i
        want[2 * i + 1] = 2 * i + (whole * common < part * (common + apart))
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(rows), ratio).collect()}
    assert {d: (c, want[d]) for d, c in got.items() if c != want[d]} == {} and len(got) == len(rows)


def test_near_duplicates_of_nothing(frame):
    assert near_duplicates(frame([])).count() == 0
    assert keep_first_of_group(frame([])).count() == 0
    assert near_duplicates(frame([(1, None), (2, "")])).count() == 2


def test_bits_keep_linked_pairs_together():
    """Pairs exactly at the threshold stay within the limit, for small and large sets and unequal sizes."""
    rng = np.random.default_rng(5)
    for common, own_a, own_b in ((85, 15, 0), (34, 3, 3), (850, 75, 75), (850, 0, 150)):
        for _ in range(700):
            values = rng.integers(0, 2**64, common + own_a + own_b, dtype=np.uint64)
            a, b = values[: common + own_a], np.concatenate([values[:common], values[common + own_a :]])
            apart = sum(int(x).bit_count() for x in (set_bits(a) ^ set_bits(b)).view(np.uint64))
            small = common + own_a + own_b <= 256
            assert apart <= (own_a + own_b if small else most_apart(0.85))


@pytest.mark.parametrize("passage, own", [(60, 500), (12, 40), (40, 150)])
def test_crowds_with_a_common_passage_are_not_compared(spark, passage, own):
    """Many classes of one list in different components: only pairs that may be similar come out of the join."""
    rng = np.random.default_rng(6)
    edit = (passage + own) // 30
    passage = rng.integers(0, 2**64, passage, dtype=np.uint64)
    sets = [np.concatenate([passage, rng.integers(0, 2**64, own, dtype=np.uint64)]) for _ in range(200)]
    sets += [np.concatenate([s[:-edit], rng.integers(0, 2**64, edit, dtype=np.uint64)]) for s in sets[1:11]]
    rows = [(7, 1, i, i, len(v), 0 if i == 0 else 3, *(int(x) for x in set_bits(v))) for i, v in enumerate(sets)]
    schema = "value bigint, band int, cid bigint, label bigint, n bigint, place int, s0 bigint, s1 bigint"
    pairs = {(r.a, r.b) for r in unsettled(spark.createDataFrame(rows, schema), (85, 100)).collect()}
    assert {(200 + i, 1 + i) for i in range(10)} <= pairs
    assert len(pairs) < 40


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1000, 1002), (5000, 5000)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_lines(frame, odd_rows):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(30)) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = list(odd_rows)
    for d in range(50, 120):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(pool).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice("xyz")
            lines.append(rng.choice(["", " "]) + "  ".join(words))
        rows.append((d, "\n".join(lines)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.removed) for r in dedup_lines(frame(rows)).collect() if r.text is not None)
    tie = {}
    from pyspark.sql import functions as F

    for r in frame(rows).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect():
        tie[r.doc_id, r.text] = r.h
    ordered = sorted({(d, t) for d, t, *_ in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, tie[x]))
    seen, kept = [], {}
    for d, t in ordered:
        stay = []
        for line in t.split("\n"):
            words = WORDS.findall(line)
            own = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            if not own or not any(5 * len(own & s) >= 4 * len(own | s) for s in seen):
                stay.append(line)
            if own:
                seen.append(own)
        kept[d, t] = "\n".join(stay), t.count("\n") + 1 - len(stay)
    assert got == sorted((-1 if d is None else d, *kept[d, t]) for d, t, *_ in rows if t is not None)
    assert dedup_lines(frame([])).count() == 0


def removed_by_hand(rows, length):
    first = {}
    for d, t in rows:
        if d is not None:
            b = (t or "").encode()
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((-1 if d is None else d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_spans(frame, odd_rows):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))
    rows = [(d, t) for d, t, *_ in odd_rows]
    for d in range(100, 160):
        own = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(0, 400)))
        a, b = sorted(rng.sample(range(301), 2))
        rows.append((d, own[:100] + passage[a:b] + own[100:] + rng.choice(["", "ab" * rng.randint(20, 90), "日本" * 20])))
    rows += [(170, rows[-1][1]), (171, rows[-1][1]), (None, passage)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept.decode()) for r in repeated_spans(frame(rows)).collect())
    assert got == removed_by_hand(rows, 50)
    assert repeated_spans(frame([])).count() == 0
    assert repeated_spans(frame([(1, None), (2, "short")])).count() == 2
    texts = {(r.doc_id, r.n_bytes): (r.kept, r.spans) for r in repeated_spans(frame(rows[20:60]), with_text=True).collect()}
    for d, t in rows[20:60]:
        kept, spans = texts[d, len(t.encode())]
        b = t.encode()
        rest = b"".join(b[i:j] for i, j in zip([0, *spans[1::2]], [*spans[::2], len(b)], strict=True))
        assert kept is None and not spans or kept == rest


def test_spans_of_short_phrases_in_common_are_not_sent(frame, monkeypatch):
    """Documents of the same short phrases in ever other orders: only windows that repeat are sent to a suffix array."""
    rng = random.Random(11)
    phrases = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(24)) for _ in range(400)]
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))
    rows = [(d, "".join(rng.choice(phrases) for _ in range(40))) for d in range(200)]
    rows += [(200 + d, t[: d % 900] + passage[d % 100 :] + t[d % 900 :]) for d, t in rows[::20]]
    sent: list[int] = []

    def persist(df):
        table = persist_reliably(df)
        if {"bucket", "places", "text"} <= set(table.columns):
            sent.extend(len(zstandard.ZstdDecompressor().decompress(r.text)) for r in table.select("text").collect())
        return table

    monkeypatch.setattr("firstborn.llm.suffix_dedup.persist_reliably", persist)
    got = repeated_spans(frame(rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept.decode()) for r in got) == removed_by_hand(rows, 50)
    assert sent and sum(sent) < sum(len(t) for _, t in rows) / 2


def test_spans_of_texts_of_many_slices(frame):
    """Runs of one byte, short periods and repeats across the slices that long texts are cut into."""
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    long = own(290_000)
    rows = [(1, long), (2, own(131_072 - 30) + long[200_000:200_400] + own(140_000)), (3, "a" * 3000 + own(200) + "xyz" * 400)]
    rows += [(4, own(70) + "a" * 1500), (5, "xyz" * 90 + long[131_000:131_200] + "zyx" * 20), (6, long[5:]), (7, long[131_072 - 49 : 131_072 + 1])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept.decode()) for r in repeated_spans(frame(rows)).collect())
    assert got == removed_by_hand(rows, 50)


def test_suffix_ranks_and_sharded_windows(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    order, ranks = suffix_ranks(data, 50)
    raw = bytes(data)
    windows = [raw[i : i + 50].ljust(50, b"\0") for i in range(len(raw))]
    assert [windows[i] for i in order] == sorted(windows)
    assert all((ranks[50][i] == ranks[50][j]) == (windows[i] == windows[j]) for i in range(0, 400, 7) for j in range(400))
    segments = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(30)]
    segments += [s[3:] + b"a" * 9 for s in segments[:10]]
    owners = np.arange(len(segments))[::-1].copy()
    one = window_owners(segments, owners)
    monkeypatch.setattr("firstborn.llm.suffix_dedup.SHARD_BYTES", 200)
    many = window_owners(segments, owners)
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(one, many, strict=True))


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors(spark, block):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 32))
    vectors = [c + rng.normal(size=32) * s for c in centres for s in (0.0, 0.05, 0.2, 0.3) for _ in range(8)]
    vectors += list(rng.normal(size=(60, 32)))
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [float("nan")] * 32, 1), (904, [None] * 32, 1), (905, [float("inf")] * 32, 0)]
    rows += [(906, [1e-30] + [0.0] * 31, 0), (907, [2e-30] + [0.0] * 31, 0), (908, [1.0, 0.0, 0.0], 0), (909, [1.0, 0.1, 0.0], 0), (910, [-5.0], 0), (911, [-1.0], 1)]
    rows += [(None, rows[0][1], 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(frame, block=block).collect()}
    clean = []
    for i, v, _ in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u = np.array(np.array(v, np.float32), float) if ok else None
        clean.append(u / np.linalg.norm(u) if ok else None)
    links = [
        (i, j)
        for i, a in enumerate(clean)
        for j, b in enumerate(clean[:i])
        if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9
    ]
    root = closed(range(len(rows)), links)
    for i, (d, *_) in enumerate(rows):
        least = min(rows[j][0] for j in root if root[j] == root[i] and rows[j][0] is not None)
        assert got[d] == (sum(i in pair for pair in links), least, d == least), d
    assert link_vectors(frame.limit(0)).count() == 0


def test_tokens_are_in_order_of_rarity(spark):
    """Every bucket in use: tokens come in order of their bucket's rank, over the whole range of ranks."""
    size = 1 << BUCKET_BITS
    ranks = np.random.default_rng(3).permutation(size).tolist()
    line = " ".join(f"word{i}" for i in range(60_000))
    row = spark.createDataFrame([(line, ranks)], "line string, ranks array<int>")
    got = row.select(ordered_tokens(F.col("line"), F.col("ranks")).alias("t"), line_shingles(F.col("line")).alias("h")).first()
    found = [(t >> (64 - BUCKET_BITS)) + size // 2 for t in got.t]
    assert found == sorted(found) and found == sorted(ranks[h & (size - 1)] for h in got.h)
    assert len(set(found)) > 0.9 * size and min(found) < 10 and max(found) > size - 10


def test_lines_of_one_large_group_and_its_neighbours(spark, frame):
    """600 near copies of one line, and lines similar to a removed copy but not to the first line."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(600):
        words = list(base)
        words[d % 60] = f"x{d}"
        rows.append((d, " ".join(words)))
    chain = [" ".join([f"c{i}" for i in range(k, k + 40)]) for k in range(0, 12, 2)]
    rows += [(1000 + i, line) for i, line in enumerate(chain)]
    rows += [(2000 + i, line) for i, line in enumerate(reversed(chain))]

    seen, gone = [], set()
    for doc_id, line in rows:
        own = shingles(line)
        if any(5 * len(own & o) >= 4 * len(own | o) for o in seen):
            gone.add(doc_id)
        seen.append(own)
    got = {r.doc_id for r in dedup_lines(frame(rows)).filter("removed > 0").collect()}
    assert got == gone
    assert {1001, 1002} <= gone
