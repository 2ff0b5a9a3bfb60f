"""Embedding near duplicates with randomised-rotation binary codes.

A random rotation spreads a unit vector evenly over its coordinates.  The signs of the
rotated coordinates are its code, and the inner product of the vector with its code, stored
beside it, corrects estimates made from the code: they are unbiased, with an error bound that
follows from the same number.  Pairs whose bound stays under the threshold are settled; the
others are computed exactly.

Pairs meet in buckets named by the largest coordinates of further rotations: two vectors of
cosine 0.9 agree in one such coordinate with probability 0.4 to 0.6, two unrelated ones almost
never, so a few dozen tables miss one link in a million.  A pair is judged in the first table
where it meets.  Large buckets are cut into blocks that are compared two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_reliably
from .common import partitions
from .components import components

#: Chance to miss one link at the threshold that the number of tables is chosen for.
MISSED = 1e-6
#: Standard deviations of the estimate within which a pair is computed exactly.
CONFIDENCE = 4.5
#: Rows of a block.
BLOCK = 1024
#: Buckets hold about this many unrelated vectors at most; more vectors, more coordinates to agree.
CROWD = 64
SEED = 29


@lru_cache(maxsize=1024)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere; number 0 makes the codes."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def corners(unit: np.ndarray, number: int) -> np.ndarray:
    """The largest coordinate of each rotated vector and its sign, as 2 * place + positive."""
    turned = unit @ rotation(unit.shape[1], number).T
    place = np.abs(turned).argmax(1)
    return 2 * place + (turned[np.arange(len(unit)), place] > 0)


@lru_cache(maxsize=64)
def tables_for(dim: int, agree: int, cosine: float) -> int:
    """Tables needed so that a pair at the threshold meets but for a chance of MISSED, by simulation."""
    rng = np.random.default_rng([SEED, dim])
    x = rng.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    meet = max(0.02, (corners(x, 1) == corners(y, 1)).mean() - 0.02) ** agree
    return int(np.ceil(np.log(MISSED) / np.log(1 - min(meet, 0.999))))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes, and the inner product of each vector with its code's unit vector."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def may_reach(unit_a, code_b, factor_b, cosine: float) -> np.ndarray:
    """Which of the pairs (a, b) an estimate from b's code does not put under the threshold."""
    dim = unit_a.shape[1]
    signs = np.unpackbits(code_b, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (unit_a @ rotation(dim, 0).T).astype(np.float32)
    estimate = turned @ signs.T / (np.sqrt(dim) * factor_b[None, :])
    error = CONFIDENCE * np.sqrt(np.maximum(1 - factor_b**2, 0)) / factor_b / np.sqrt(max(dim - 1, 1))
    return estimate + error[None, :] >= cosine - 1e-6


def linked(a: dict, b: dict | None, table: int, cosine: float) -> np.ndarray:
    """The links of a block with itself or with another, judged in this table: a boolean matrix."""
    other = a if b is None else b
    todo = np.ones((len(a["cid"]), len(other["cid"])), bool)
    if b is None:
        todo = np.triu(todo, 1)
    for earlier in range(table):
        todo &= a["keys"][:, earlier, None] != other["keys"][None, :, earlier]
    if a["unit"].shape[1] >= 16 and todo.any():
        todo &= may_reach(a["unit"], other["code"], other["factor"], cosine)
        todo &= may_reach(other["unit"], a["code"], a["factor"], cosine).T
    rows, columns = np.nonzero(todo)
    for start in range(0, len(rows), 1 << 16):
        i, j = rows[start : start + (1 << 16)], columns[start : start + (1 << 16)]
        todo[i, j] = np.einsum("ij,ij->i", a["unit"][i], other["unit"][j]) >= cosine
    return todo


def roots(adjacent: np.ndarray) -> np.ndarray:
    """The least row number reachable from each row of a symmetric matrix."""
    label = np.arange(len(adjacent))
    while True:
        near = np.where(adjacent, label[None, :], len(adjacent)).min(1, initial=len(adjacent))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their class key, classes): equal vectors are one class."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # Two hashes of 64 bits; 0.0 is added so that -0.0 and 0.0 hash alike.
    same = F.transform("v", lambda x: x + F.lit(0.0))
    keyed = rows.withColumn("k1", F.when(good, F.xxhash64(same))).withColumn("k2", F.when(good, F.xxhash64(F.lit(1), same)))
    classes = (
        keyed.filter("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    return keyed.drop("v"), persist_reliably(classes)


def _unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _coder(agree: int, cosine: float):
    """Arrow function: classes to unit vectors with code, factor and the bucket of every table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lengths = np.array([len(v) for v in rows.column("v")])
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                part = rows.take(pa.array(at))
                unit = _unit(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))
                codes, factors = encode(unit)
                tables = tables_for(int(dim), agree, cosine)
                keys = np.zeros((len(at), tables), np.int64)
                for t in range(tables):
                    for c in range(agree):
                        keys[:, t] = keys[:, t] * (2 * dim) + corners(unit, 1 + t * agree + c)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("cid"), part.column("copies"), pa.array([dim] * len(at), pa.int32()),
                        pa.array([u.tobytes() for u in unit], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(factors, pa.float64()), pa.array(keys.tolist(), pa.list_(pa.int64())),
                    ],
                    ["cid", "copies", "dim", "unit", "code", "factor", "keys"],
                )

    return code


def _block(rows: list[tuple], dim: int) -> dict:
    cid, copies, unit, code, factor, keys = zip(*rows, strict=True)
    return {
        "cid": np.array(cid, np.int64),
        "copies": np.array(copies, np.int64),
        "unit": np.frombuffer(b"".join(unit)).reshape(-1, dim),
        "code": np.frombuffer(b"".join(code), np.uint8).reshape(len(cid), -1),
        "factor": np.array(factor),
        "keys": np.array(keys, np.int64),
    }


def _comparer(cosine: float):
    """Arrow function over rows sorted by block pair: link counts and a spanning forest of each pair."""
    names = ("dim", "tab", "bucket", "i", "j", "part", "cid", "copies", "unit", "code", "factor", "keys")

    def judge(key: tuple, rows: list[tuple]):
        dim, table, _, i, j = key
        first = [r[1:] for r in rows if r[0] == i]
        second = [r[1:] for r in rows if r[0] == j] if i != j else None
        if not first or (i == j and len(first) < 2) or (i != j and not second):
            return None
        a = _block(first, dim)
        b = None if second is None else _block(second, dim)
        found = linked(a, b, table, cosine)
        if not found.any():
            return None
        if b is None:
            near = found | found.T
            cid, links = a["cid"], near @ a["copies"]
        else:
            cid = np.concatenate([a["cid"], b["cid"]])
            links = np.concatenate([found @ b["copies"], found.T @ a["copies"]])
            near = np.zeros((len(cid), len(cid)), bool)
            near[: len(found), len(found) :] = found
            near |= near.T
        return cid, links, cid[roots(near)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, out = None, [], []

        def flush():
            if held_key is not None and (result := judge(held_key, held)) is not None:
                keep = result[1] > 0
                out.append([x[keep] for x in result])

        def emit():
            arrays = [np.concatenate(x) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["cid", "links", "root"])

        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in names]
            for row in zip(*columns, strict=True):
                if row[:5] != held_key:
                    flush()
                    held_key, held = row[:5], []
                held.append(row[5:])
            if out:
                yield emit()
        flush()
        if out:
            yield emit()

    return compare


def link_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vec_id, embedding.

    Two rows are linked if the cosine of their vectors, in double precision, is at least
    ``cosine``.  n_links counts the other rows linked directly, copies included; component_id
    is the least vec_id reachable and kept is whether the row has it.  Null, empty and zero
    vectors, and vectors with null or non-finite components, link with nothing; vectors of
    different length do not link.  Rows with equal ids are kept or not together; null ids name a component only
    where every id is null.  An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, classes = _classes(vectors)
    size = max(classes.count(), 1)
    smallest = classes.agg(F.min(F.size("v"))).first()[0] or 1
    agree = max(1, int(np.ceil(np.log(size / CROWD) / np.log(2 * max(smallest, 2))))) if size > CROWD else 1
    coded = persist_reliably(
        classes.select("cid", "copies", "v")
        .repartition(partitions(spark), "cid")
        .mapInArrow(
            _coder(agree, cosine),
            "cid bigint, copies bigint, dim int, unit binary, code binary, factor double, keys array<bigint>",
        )
    )
    places = coded.select("cid", "dim", F.posexplode("keys").alias("tab", "bucket"))
    crowds = places.groupBy("dim", "tab", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = places.join(crowds, ["dim", "tab", "bucket"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # A row of a bucket of s blocks takes part in s block pairs.
    pairs = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "dim", "tab", "bucket", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "cid"
    )
    payload = coded.select("cid", "copies", "unit", "code", "factor", "keys")
    keys = ["dim", "tab", "bucket", "i", "j"]
    found = persist_reliably(
        pairs.join(payload, "cid")
        .repartition(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_comparer(cosine), "cid bigint, links bigint, root bigint")
    )
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cid")
    named = (
        classes.select("cid", "k1", "k2", "least", "copies")
        .join(links, "cid", "left")
        .join(joined, "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = named.join(least, "component").select(
        "k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    # A class of many copies is one row of the other side.
    out = rows.join(facts, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
