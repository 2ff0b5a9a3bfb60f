"""Token counts without token lists.

Texts are cut at safe boundaries into pieces, the distinct pieces of a batch are encoded
together, and only lengths leave the task.  A byte-level splitting pattern never joins a
space to the character before it, so the position before a space that follows a
non-space is a boundary of every segmentation: the counts of the parts add up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Bytes of text whose distinct pieces are encoded in one call.
BATCH_BYTES = 4 << 20
#: Distinct pieces a worker remembers before it starts anew.
REMEMBERED = 400_000

_UNSAFE_SPACE = re.compile(r"\s ")
_SAFE_SPACE = re.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces(text: str) -> list[str]:
    """The text cut before every space that follows a non-space."""
    if _UNSAFE_SPACE.search(text):
        return _SAFE_SPACE.split(text)
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)]


def slices(texts: list[str], batch_bytes: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Batches of (text number, pieces) of about ``batch_bytes``; a long text spans several."""
    batch, held = [], 0
    for number, text in enumerate(texts):
        parts = pieces(text)
        if len(text) <= batch_bytes:
            batch.append((number, parts))
            held += len(text)
        else:
            start = size = 0
            for end, part in enumerate(parts, 1):
                size += len(part)
                if held + size >= batch_bytes:
                    yield [*batch, (number, parts[start:end])]
                    batch, held, start, size = [], 0, end, 0
            batch.append((number, parts[start:]))
            held += size
        if held >= batch_bytes:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def counter(tokenizer_path: str, batch_bytes: int, remembered: int):
    """Arrow function: (doc_id, text) to (doc_id, n_bytes, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        known: dict[str, int] = {"": 0}
        for rows in batches:
            texts = rows.column("text").to_pylist()
            totals = [0] * len(texts)
            for batch in slices(texts, batch_bytes):
                if len(known) > remembered:
                    known = {"": 0}
                new = list(set().union(*(parts for _, parts in batch)).difference(known))
                for start in range(0, len(new), 20_000):
                    part = new[start : start + 20_000]
                    encoded = tokenizer.encode_batch_fast(part, add_special_tokens=False)
                    known.update(zip(part, map(len, encoded), strict=True))
                for number, parts in batch:
                    totals[number] += sum(map(known.__getitem__, parts))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(totals, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return count


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    batch_bytes: int = BATCH_BYTES,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row's whole text.

    A null text counts as empty: no bytes and no tokens.  Repeated rows and repeated or null
    ids give a row each; columns other than doc_id and text are ignored.  An empty table
    gives no rows.  Long texts are encoded in parts of at most ``batch_bytes``.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(
        counter(tokenizer_path, batch_bytes, remembered),
        "doc_id bigint, n_bytes bigint, n_tokens bigint",
    )
