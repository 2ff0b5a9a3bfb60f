"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages.  Every passage of a text is encoded by counts over its
bytes and words; gated attention weighs the passages, and a logistic unit scores the
weighted representation.  Labels belong to documents only; attention learns which
passages speak for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

PASSAGE_BYTES = 1024
#: The model is fitted on at most this many labelled documents, the first by a hash of doc_id,
#: and at most this many evenly spaced passages of each.
FIT_DOCUMENTS = 6_000
FIT_PASSAGES = 48
#: Bytes of text encoded at a time; the arrays take about a hundred times as much.
SLICE = 1 << 17
HIDDEN = 16
STEPS = 400

# Byte classes, by their members (fixed values).
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" \t\x0b\x0c\r",
    b"\n",
    b".",
    b",;:",
    b"!?",
    b"#*$%&<>",
    b"|",
    b"\"'()-",
    b"@/\\_=+~^`[]{}",
)
OTHER_ASCII, HIGH = len(CLASSES), len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
FEATURES = N_CLASSES + 7

_CLASS_OF = np.full(256, OTHER_ASCII, np.uint8)
_CLASS_OF[128:] = HIGH
for _number, _members in enumerate(CLASSES):
    _CLASS_OF[list(_members)] = _number
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def encode_passages(texts: list[bytes], passage_bytes: int = PASSAGE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); an empty text is one empty passage."""
    sizes = np.array([len(t) for t in texts], np.int64)
    per_text = np.maximum(1, -(-sizes // passage_bytes))
    total = int(per_text.sum())
    data = np.frombuffer(b"".join(texts), np.uint8)
    first_of = np.cumsum(per_text) - per_text
    begin_of = np.cumsum(sizes) - sizes
    within = np.arange(total) - np.repeat(first_of, per_text)
    begin = np.repeat(begin_of, per_text) + within * passage_bytes
    length = np.minimum(passage_bytes, np.repeat(begin_of + sizes, per_text) - begin)
    passage_of = np.repeat(np.arange(total), length)

    counts = np.bincount(passage_of * N_CLASSES + _CLASS_OF[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    space = _IS_SPACE[data]
    starts_here = np.zeros(len(data), bool)
    starts_here[begin[length > 0]] = True
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1] | starts_here[1:]
    stop = word.copy()
    stop[:-1] &= space[1:] | starts_here[1:]
    at, end = np.flatnonzero(start), np.flatnonzero(stop)
    owner = passage_of[at]
    n_words = np.bincount(owner, minlength=total)
    lengths = end - at + 1
    # A word's hash: a difference of running polynomial sums, brought back to power 0.
    powers = np.cumprod(np.full(len(data), _STEP, np.uint64), dtype=np.uint64)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)
    back = np.cumprod(np.full(len(data), _BACK, np.uint64), dtype=np.uint64)
    before = np.where(at > 0, sums[np.maximum(at, 1) - 1], np.uint64(0))
    hashes = (sums[end] - before) * back[at]
    same = np.zeros(len(at), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    new = np.ones(len(at), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=total)
    capital = np.bincount(owner, weights=_CLASS_OF[data[at]] == 0, minlength=total)
    symbol = np.bincount(owner, weights=(_CLASS_OF[data[end]] >= 7) & (_CLASS_OF[data[end]] <= 9), minlength=total)
    mean = np.bincount(owner, weights=lengths, minlength=total) / np.maximum(n_words, 1)
    square = np.bincount(owner, weights=lengths.astype(float) ** 2, minlength=total) / np.maximum(n_words, 1)

    words = np.maximum(n_words, 1)
    out = np.empty((total, FEATURES), np.float32)
    out[:, :N_CLASSES] = np.sqrt(counts / np.maximum(length, 1)[:, None])
    out[:, N_CLASSES] = np.log1p(n_words) / 6
    out[:, N_CLASSES + 1] = mean / 10
    out[:, N_CLASSES + 2] = np.sqrt(np.maximum(square - mean**2, 0)) / 10
    out[:, N_CLASSES + 3] = distinct / words
    out[:, N_CLASSES + 4] = np.bincount(owner, weights=same, minlength=total) / words
    out[:, N_CLASSES + 5] = capital / words
    out[:, N_CLASSES + 6] = symbol / words
    return out, per_text


def byte_slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in order, null as empty, in parts of SLICE bytes and at most one text more: (first, texts)."""
    part, held, first = [], 0, 0
    for at, text in enumerate(texts):
        value = text.as_py() or b""
        part.append(value.encode() if isinstance(value, str) else value)
        held += len(part[-1])
        if held >= SLICE:
            yield first, part
            part, held, first = [], 0, at + 1
    if part:
        yield first, part


@dataclass
class AttentionModel:
    """Gated attention (tanh times sigmoid) over passages, and a logistic unit on their weighted sum."""

    centre: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # FEATURES x HIDDEN
    value: np.ndarray  # HIDDEN x HIDDEN, the tanh half
    gate: np.ndarray  # HIDDEN x HIDDEN, the sigmoid half
    weight: np.ndarray  # HIDDEN
    out: np.ndarray  # HIDDEN
    bias: np.ndarray  # 1

    NAMES = ("encode", "value", "gate", "weight", "out", "bias")

    def forward(self, x: np.ndarray, per_text: np.ndarray):
        first = np.cumsum(per_text) - per_text
        bag = np.repeat(np.arange(len(per_text)), per_text)
        h = np.tanh((x - self.centre) / self.scale @ self.encode)
        t, g = np.tanh(h @ self.value), _sigmoid(h @ self.gate)
        energy = (t * g) @ self.weight
        energy = np.exp(energy - np.maximum.reduceat(energy, first)[bag])
        attention = energy / np.add.reduceat(energy, first)[bag]
        z = np.add.reduceat(attention[:, None] * h, first)
        score = _sigmoid(z @ self.out + self.bias[0])
        return h, t, g, bag, first, attention, z, score

    def score(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return self.forward(x, per_text)[-1]

    def gradients(self, x: np.ndarray, per_text: np.ndarray, y: np.ndarray, weight: np.ndarray):
        h, t, g, bag, first, a, z, score = self.forward(x, per_text)
        d_logit = (score - y) * weight
        d_z = d_logit[:, None] * self.out
        d_h = a[:, None] * d_z[bag]
        d_a = (h * d_z[bag]).sum(1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, first)[bag])
        d_tg = d_e[:, None] * self.weight
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_h += d_t @ self.value.T + d_g @ self.gate.T
        d_in = d_h * (1 - h * h)
        return {
            "encode": ((x - self.centre) / self.scale).T @ d_in,
            "value": h.T @ d_t,
            "gate": h.T @ d_g,
            "weight": (d_e[:, None] * t * g).sum(0),
            "out": z.T @ d_logit,
            "bias": np.array([d_logit.sum()]),
        }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_attention(
    x: np.ndarray, per_text: np.ndarray, y: np.ndarray, steps: int = STEPS, hidden: int = HIDDEN, seed: int = 5
) -> AttentionModel:
    """Full-batch Adam on the mean log loss with a small weight decay; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    model = AttentionModel(
        x.mean(0),
        x.std(0) + 0.02,
        rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)),
        rng.normal(0, hidden**-0.5, (hidden, hidden)),
        rng.normal(0, hidden**-0.5, (hidden, hidden)),
        rng.normal(0, hidden**-0.5, hidden),
        rng.normal(0, hidden**-0.5, hidden),
        np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))]),
    )
    weight = np.full(len(y), 1 / len(y))
    m = {k: 0.0 for k in model.NAMES}
    v = {k: 0.0 for k in model.NAMES}
    for step in range(1, steps + 1):
        for k, g in model.gradients(x, per_text, y, weight).items():
            p = getattr(model, k)
            g = g + 1e-4 * p * (k != "bias")
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p -= 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    fit_documents: int = FIT_DOCUMENTS,
    fit_passages: int = FIT_PASSAGES,
    steps: int = STEPS,
) -> AttentionModel | float:
    """Fit on labelled documents: doc_id and quality (0 or 1).

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are used, at most ``fit_documents`` of
    them.  Rows with a null doc_id or quality are left out; several labels of one document
    are averaged and rounded; of repeated documents the first text in order counts.  Without
    labels, or with one class only, the result is that class's share (0.5 without labels)
    and stands for a constant score.
    """
    rows = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y"))
        .dropna()
        .filter(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.round(F.avg("y")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_documents)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in byte_slices(batch.column("text")):
                part = batch.slice(start, len(texts))
                x, per_text = encode_passages(texts)
                first = np.cumsum(per_text) - per_text
                flat = []
                for at, n in zip(first, per_text, strict=True):
                    picked = np.unique(np.linspace(0, n - 1, min(n, fit_passages)).astype(int)) + at
                    flat.append(x[picked].ravel().tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y"), pa.array(flat, pa.list_(pa.float32()))], ["doc_id", "y", "x"]
                )

    # The sample has at most fit_documents rows, so its broadcast is bounded.
    sample = (
        texts.join(F.broadcast(rows), "doc_id")
        .mapInArrow(encode, "doc_id bigint, y double, x array<float>")
        .toPandas()
    )
    sample["n"] = sample["x"].map(len)
    sample["k"] = sample["x"].map(lambda v: np.asarray(v, np.float32).tobytes())
    sample = sample.sort_values(["doc_id", "n", "k"]).drop_duplicates("doc_id")
    y = sample["y"].to_numpy()
    if not len(y):
        return 0.5
    if len(set(y)) < 2:
        return float(y[0])
    per_text = sample["n"].to_numpy() // FEATURES
    x = np.concatenate([np.asarray(v, np.float32) for v in sample["x"]]).reshape(-1, FEATURES)
    return fit_attention(x, per_text, y, steps)


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, model: AttentionModel | float) -> DataFrame:
    """Adds score, 0 to 1, from every passage of the whole text, to doc_id and text of each row.

    A null text is scored as an empty one, which is a single passage without words.  Repeated
    rows are scored alike; an empty table gives no rows; other columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = [
                np.full(len(part), model) if isinstance(model, float) else model.score(*encode_passages(part))
                for _, part in byte_slices(rows.column("text"))
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())], ["doc_id", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, score double")


def passing(batches: Iterator[pa.RecordBatch], model: AttentionModel | float, at_least: float) -> Iterator[pa.RecordBatch]:
    """The rows whose text scores ``at_least``, a slice at a time: no second copy of a batch is held."""
    for rows in batches:
        for first, part in byte_slices(rows.column("text")):
            scores = np.full(len(part), model) if isinstance(model, float) else model.score(*encode_passages(part))
            yield rows.slice(first, len(part)).filter(pa.array(scores >= at_least))


def keep_quality(docs: DataFrame, model: AttentionModel | float, at_least: float, columns: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` whose text scores ``at_least``, with their columns, in one pass."""
    slim = docs.select(*columns)
    return slim.mapInArrow(lambda batches: passing(batches, model, at_least), slim.schema)
