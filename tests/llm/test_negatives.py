import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from firstborn.llm.hard_negatives import Heaps, mine_hard_negatives, strassen, window
from firstborn.llm.oracles import HARD_NEGATIVES

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, dim int, score string, grp string, place int, v string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (64, 64, 64), (130, 64, 257), (100, 3, 200), (97, 131, 65), (0, 5, 3)])
def test_strassen(shape):
    n, k, m = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 26), 1 << 26, (n, k)), rng.integers(-(1 << 26), 1 << 26, (k, m))
    for leaf in (4, 32):
        assert (strassen(a, b, leaf) == a @ b).all()
    # Sums that leave 64 bits on the way come back: the ring is exact modulo 2^64.
    a[:], b[:] = np.where(a > 0, 1 << 40, -(1 << 40)), np.where(b > 0, 1 << 22, -(1 << 22))
    assert (strassen(a, b, 4) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    ids = rng.permutation(400)
    scores = rng.integers(-3, 4, (6, 400))  # many ties
    allowed = rng.random((6, 400)) < 0.5
    allowed[5] = False
    heaps = Heaps(8, 7)
    for part in np.array_split(rng.permutation(400), 9):
        part = part[np.argsort(ids[part])]
        heaps.offer(np.arange(6) + 1, scores[:, part], allowed[:, part], ids[part])
    slot, score, kept = heaps.kept()
    for r in range(6):
        want = sorted((-scores[r, c], ids[c]) for c in range(400) if allowed[r, c])[:7]
        assert [(-s, i) for k, s, i in zip(slot, score, kept) if k == r + 1] == want


def test_window_has_no_overflow():
    p = np.array([0, 1, 7, 10, 101, -5, 1 << 61], np.int64)
    low, high = window(p, (3, 10), (9, 10))
    for x, a, b in zip(p.tolist(), low.tolist(), high.tolist()):
        assert a == math.ceil(3 * x / 10) or x > 1 << 50 and a == -(-3 * x // 10)
        assert b == 9 * x // 10


def whole(vector):
    if not vector or any(x is None or not math.isfinite(x) for x in vector):
        return None
    most = 1 << 26
    return [max(-most, min(most, math.floor(256 * np.float32(x).astype(float)))) for x in vector]


def brute(rows, label, positives=5, negatives=10):
    live = [(i, label(i, k), whole(v)) for i, v, k, *_ in rows if i is not None and k is not None and whole(v)]
    out = []
    for a, k, v in {(a, k, tuple(v)) for a, k, v in live if a % 100 == 0}:
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: B023, E731
        met = sorted((-score(w), i, j == k) for i, j, w in live if len(w) == len(v) and i != a)
        for p, i, _ in [x for x in met if x[2]][:positives]:
            inside = [(s, j) for s, j, same in met if not same and 3 * -p <= 10 * -s <= 9 * -p]
            out += [(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def vectors(n=1500, dims=(24,)):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 64)) + 0.6
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else int(rng.integers(0, 6))  # a third of all rows have one label
        x = (centres[label] + rng.normal(size=64)) / 4
        if i % 5 == 0:
            x = centres[0] / 4  # many copies: ties
        rows.append((i * 2, [float(v) for v in x[: dims[i % len(dims)]]], label))
    return rows


ODD = [
    (None, [1.0] * 24, 1), (3, None, 1), (5, [], 1), (9, [1.0] * 24, None), (11, [float("nan")] * 24, 2), (13, [float("inf")] * 24, 2),
    (15, [None] * 24, 1), (400, [0.5] * 24, 1), (400, [0.5] * 24, 1), (400, [0.25] * 24, 2), (17, [0.1] * 24, 1), (17, [0.1] * 24, 1),
    (500, [0.0] * 24, 4), (700, [-0.5] * 24, 5), (19, [1e30, -1e30] * 12, 3), (800, [1e30] * 24, 3), (21, [0.5], 1), (900, [0.25], 1), (23, [0.2], 2),
]


@pytest.mark.parametrize("block, dims", [(1024, (24,)), (2, (24, 7)), (5, (40, 24))])
def test_mined_negatives(spark, block, dims):
    rows = vectors(dims=dims) + ODD
    table = spark.createDataFrame([(*r, "a", 1, "b", "c", 2, "d") for r in rows], SCHEMA).repartition(3)
    label = lambda i, k: (k + 1) % 10 if i % 7 == 0 else k
    column = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = mine_hard_negatives(table, column, F.col("vec_id") % 100 == 0, block=block)
    assert dict(mined.dtypes) == {
        "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint",
    }
    want = brute(rows, label)
    assert len(want) > 300 and sorted(map(tuple, mined.collect())) == want


def test_mining_nothing(spark):
    for rows in ([], [(100, [1.0], 1)], [(1, [1.0], 1), (2, [0.5], 2)], [(100, [1.0], 1), (2, [0.5], 1)], [(100, None, 1)]):
        table = spark.createDataFrame([(*r, "a", 1, "b", "c", 2, "d") for r in rows], SCHEMA)
        assert mine_hard_negatives(table, F.col("label"), F.col("vec_id") % 100 == 0).count() == 0


def test_sql(spark):
    from firstborn.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = QUERIES["op13_hard_negatives"](spark, sf)
    want = con.execute(HARD_NEGATIVES)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
