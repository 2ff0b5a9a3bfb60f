import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from firstborn.llm.merkle import BLOCK_BITS, build_manifest, hex_text, parent_digest, prove
from firstborn.llm.merkle_sql import MERKLE

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = {**row, "text": text}
    return h("-" if values[f] is None else f"{len(str(values[f]).encode())}:{values[f]}" for f in FIELDS)


def tree(leaves):
    """The root, and for every leaf the digests left and right of it on each level."""
    rungs, below, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        runs = [range(k, min(k + 16, len(nodes))) for k in range(0, len(nodes), 16)]
        for run in runs:
            for k in run:
                for i in below[k]:
                    rungs[i].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        nodes, below = [h(nodes[j] for j in run) for run in runs], [sum((below[j] for j in run), []) for run in runs]
    return nodes[0], rungs


def expected(rows):
    by = {}
    for row in rows:
        by.setdefault(row["source"], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        made[s] = tree([leaf(r, r["text"]) for r in by[s]])
    if not order:
        return []
    root, tops = tree([made[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for row, rungs in zip(by[s], made[s][1], strict=True):
            text, d = row["text"], row["doc_id"]
            if d is not None and text is not None and zlib.crc32(str(d).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded, siblings = leaf(row, text), []
            for left, right in rungs + top:
                siblings += left + right
                folded = h([*left, folded, *right])
            out.append((d, leaf(row, row["text"]), made[s][0], root, h(siblings), folded, folded == root))
    return out


def digest_rows(docs):
    proofs = prove(build_manifest(docs))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", hex_text(parent_digest(F.col("siblings"))).alias("p"), "folded_root", "verified"
    )


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def many_sources():
    """A hot source, sources at the edges of a level, and more sources than one run holds."""
    rng = random.Random(3)
    sizes = {"hot": 700, "one": 1, "two": 2, "full": 16, "over": 17, "square": 256, "more": 257, None: 40, "": 3, "é": 5, "Z": 18}
    sizes |= {f"s{i}": rng.choice([1, 1, 2, 20]) for i in range(40)}
    rows, d = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            d += 1
            rows.append((d * 7 % 5003, rng.choice([f"Text {d}", "same", None, "", f"low {d}"]), rng.choice(["en", None]), source))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("odd", [False, True])
def test_manifest(frame, odd_rows, odd):
    docs = frame(odd_rows if odd else many_sources())
    want = expected([r.asDict() for r in docs.collect()])
    got = [tuple(r) for r in digest_rows(docs).collect()]
    assert ordered(got) == ordered(want)
    # None of the odd rows both is tampered with and has capitals.
    assert any(r[-1] for r in got) and any(not r[-1] for r in got) != odd


def test_manifest_of_few_rows(frame):
    assert digest_rows(frame([])).count() == 0
    for rows in ([(1, "A B")], [(None, None)], [(i, "x") for i in range(16)], [(1, "A", "en", None), (2, "B", "en", "b")]):
        docs = frame(rows)
        assert ordered(map(tuple, digest_rows(docs).collect())) == ordered(expected([r.asDict() for r in docs.collect()]))


def test_node_rows(frame):
    """Every node but the root has a parent row that holds its digest at its place; ranges nest."""
    manifest = build_manifest(frame(many_sources()))
    nodes = {r.number: r for r in manifest.nodes.collect()}
    roots = [r for r in nodes.values() if r.parent is None]
    assert len(nodes) == manifest.nodes.count() and len(roots) == 1
    assert bytes(roots[0].digest) == bytes(manifest.root.first().digest)
    for r in nodes.values():
        assert h([bytes(r.children).hex()]) == bytes(r.digest).hex() and len(r.children) <= 16 * 32
        if r.parent is not None:
            up = nodes[r.parent]
            assert bytes(up.children)[32 * r.place : 32 * r.place + 32] == bytes(r.digest)
            assert up.lo <= r.lo <= r.hi <= up.hi and up.level > r.level
    assert all(r.parent in nodes for r in manifest.runs.collect())


def test_climb_over_several_blocks(spark, frame, monkeypatch):
    """A node row is met by the runs of one block of positions only, the root's row too."""
    import firstborn.llm.merkle as merkle

    assert BLOCK_BITS == 16
    monkeypatch.setattr(merkle, "BLOCK_BITS", 6)
    docs = frame(many_sources())
    assert ordered(map(tuple, digest_rows(docs).collect())) == ordered(expected([r.asDict() for r in docs.collect()]))


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = [tuple(r) for r in digest_rows(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    assert sorted(got) == sorted(con.execute(MERKLE).fetchall())
