"""Compare registered queries with their SQL: python check.py SF_DIR [name ...]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from firstborn.session import local_session
from firstborn.workload import ORACLES, QUERIES


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in data),
        key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t),
    )


def compare(spark, con, name: str, sf: str) -> str:
    start = time.time()
    frame = QUERIES[name](spark, sf)
    got = [tuple(r) for r in frame.collect()]
    spent = time.time() - start
    if name not in ORACLES:
        return f"rows-only {len(got)} rows  spark {spent:.2f}s"
    start = time.time()
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    types = {d[0]: str(d[1]) for d in cur.description}
    took = time.time() - start
    tail = f"{len(got)} rows  spark {spent:.2f}s duckdb {took:.2f}s"
    if sorted(frame.columns) != sorted(names):
        return f"FAIL columns {sorted(frame.columns)} != {sorted(names)}  {tail}"
    wide = [n for n, t in types.items() if t in ("HUGEINT", "DECIMAL") or t.startswith("DECIMAL")]
    if wide:
        return f"FAIL SQL types {wide}  {tail}"
    if len(got) != len(want):
        return f"FAIL {len(got)} rows, SQL has {len(want)}  {tail}"
    mine, theirs = rows_of(frame.columns, got), rows_of(names, want)
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"FAIL {len(bad)} of {len(mine)} rows differ, e.g. {bad[:2]}  {tail}"
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    return f"ok {tail}  {kinds if '-v' in sys.argv else ''}"


if __name__ == "__main__":
    sf = sys.argv[1]
    picked = [a for a in sys.argv[2:] if a != "-v"]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failures = 0
    for name in QUERIES:
        if picked and not any(name.startswith(p) for p in picked):
            continue
        try:
            line = compare(spark, con, name, sf)
        except Exception as error:  # report every query, then fail
            line = "FAIL " + type(error).__name__ + " " + str(error)[:700]
        failures += line.startswith("FAIL")
        print(f"{name:32s} {line}", flush=True)
    print("failures:", failures)
    sys.exit(failures > 0)
