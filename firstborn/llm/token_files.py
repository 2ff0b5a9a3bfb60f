"""Token-id files: blocks of ids as bit or byte planes, each compressed, with a chunk index.

Layout of a file::

    magic "PLANES01"
    blocks     every block: its planes one after another, each a zstandard frame
    index      zstandard frame of int64 rows (offset, ids, planes, bytes per plane ...)
    trailer    int64 offset and length of the index, number of blocks, 1 for bit planes; magic

A block holds ``block_ids`` ids (the last fewer).  Transposing it puts equal significance
next to each other: high planes are nearly constant and compress to nothing.
"""

from __future__ import annotations

import io
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import persist_reliably
from .common import partitions, whole_text
from .token_counts import load_tokenizer

MAGIC = b"PLANES01"
BLOCK_IDS = 1 << 16
MOST_PLANES = 32
LEVEL = 1
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 500_000


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of uint32 ids, least significant first; only as many as the largest id needs."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    if bits:
        return [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(width)]
    columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(columns[:, b]).tobytes() for b in range((width + 7) // 8)]


def join_planes(planes: list[bytes], count: int, bits: bool) -> np.ndarray:
    if bits:
        ids = np.zeros(count, np.uint32)
        for b, plane in enumerate(planes):
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count).astype(np.uint32) << np.uint32(b)
        return ids
    columns = np.zeros((count, 4), np.uint8)
    for b, plane in enumerate(planes):
        columns[:, b] = np.frombuffer(plane, np.uint8)
    return columns.view("<u4").ravel()


class PlaneWriter:
    """Writes ids to a binary stream, block by block."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = LEVEL):
        self.stream, self.block_ids, self.bits = stream, block_ids, bits
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.index: list[list[int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.offset = stream.write(MAGIC)

    def write(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % self.block_ids
            for start in range(0, cut, self.block_ids):
                self._block(whole[start : start + self.block_ids])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.compress(p) for p in split_planes(ids, self.bits)]
        sizes = [len(f) for f in frames]
        self.index.append([self.offset, len(ids), len(sizes), *sizes, *[0] * (MOST_PLANES - len(sizes))])
        for frame in frames:
            self.offset += self.stream.write(frame)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        packed = self.compress(np.array(self.index, "<i8").tobytes())
        self.stream.write(packed)
        self.stream.write(np.array([self.offset, len(packed), len(self.index), self.bits], "<i8").tobytes() + MAGIC)


class PlaneReader:
    """Reads any range of ids of a file; decodes only the blocks that it touches."""

    def __init__(self, stream, size: int):
        self.stream = stream
        trailer = 4 * 8 + len(MAGIC)
        stream.seek(size - trailer)
        tail = stream.read(trailer)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token-id file, or cut short")
        at, length, blocks, self.bits = (int(x) for x in np.frombuffer(tail[:32], "<i8"))
        stream.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(stream.read(length)) if blocks else b""
        self.index = np.frombuffer(raw, "<i8").reshape(blocks, 3 + MOST_PLANES)
        self.ends = np.cumsum(self.index[:, 1])
        self.block = lru_cache(maxsize=2)(self._block)

    def _block(self, number: int) -> np.ndarray:
        offset, count, planes = (int(x) for x in self.index[number, :3])
        sizes = self.index[number, 3 : 3 + planes]
        self.stream.seek(offset)
        raw = self.stream.read(int(sizes.sum()))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        undo = zstandard.ZstdDecompressor().decompress
        frames = [undo(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return join_planes(frames, count, bool(self.bits))

    def read(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids [start, start + count), a block's share at a time."""
        number = int(np.searchsorted(self.ends, start, side="right"))
        while count > 0:
            block = self.block(number)
            first = start - (int(self.ends[number]) - len(block))
            part = block[first : first + count]
            yield part
            start, count, number = start + len(part), count - len(part), number + 1


class _WordIds(dict):
    """Little-endian uint32 ids of a word; white space always separates pre-tokens."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.older: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes], remembered: int) -> None:
        """Have the ids of all these words here; words not met for long are forgotten."""
        if len(self) > remembered:
            self.older = dict(self)
            self.clear()
        new = []
        for word in words.difference(self):
            found = self.older.get(word)
            if found is None:
                new.append(word)
            else:
                self[word] = found
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            for word, enc in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self[word] = array("I", enc.ids).tobytes()


@lru_cache(maxsize=1)
def _known_words(tokenizer_path: str) -> _WordIds:
    """What this worker has encoded so far, shared by its tasks."""
    return _WordIds(load_tokenizer(tokenizer_path))


def _writer(folder: str, tokenizer_path: str, end_id: int, block_ids: int, bits: bool, remembered: int):
    """Arrow function: sorted (doc_id, text) to a file per partition and its document index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = FileSystem.from_uri(folder)
        name = f"part-{context.partitionId():06d}.ids"
        partial = f"{root}/{name}.{context.taskAttemptId()}"
        ids_of = _known_words(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        stream = writer = None
        start = 0
        for rows in batches:
            if stream is None:
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(partial)
                writer = PlaneWriter(stream, block_ids, bits)
            starts, sizes = [], []
            text = rows.column("text")
            at = 0
            while at < len(text):  # by the byte, so that words of a batch fit in memory
                batch, held = [], 0
                while at < len(text) and held < 4 << 20:
                    words = text[at].as_py().split()
                    held += 1 + len(text[at].as_buffer())
                    batch.append(words)
                    at += 1
                ids_of.learn(set().union(*batch), remembered)
                for words in batch:
                    ids = np.frombuffer(b"".join([*map(ids_of.__getitem__, words), end]), "<u4")
                    writer.write(ids)
                    starts.append(start)
                    sizes.append(len(ids))
                    start += len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(sizes), pa.string()),
                    rows.column("doc_id"),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                ["file", "doc_id", "file_start", "n_tokens"],
            )
        if stream is not None:
            writer.close()
            stream.close()
            # A retried or speculative attempt has the same rows, so the last rename wins.
            store.move(partial, f"{root}/{name}")

    return write


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    block_ids: int = BLOCK_IDS,
    bits: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order.

    Returns the document index: file, doc_id, file_start, n_tokens (with the end id) and
    start, the number of ids in all documents before it.  Files follow the doc_id order by
    name.  A null text is empty: its document is the end id alone.  Null ids come first;
    rows with equal ids keep a fixed order by text.  An empty table writes no file.
    ``folder`` is a URI that every executor can write to.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text")
    )
    ranged = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    index = persist_reliably(
        ranged.mapInArrow(
            _writer(folder, tokenizer_path, end_id, block_ids, bits, remembered),
            "file string, doc_id bigint, file_start bigint, n_tokens bigint",
        )
    )
    # One row per file: the window and the broadcast are as small as the number of partitions.
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return index.join(F.broadcast(bases), "file").withColumn("start", F.col("_base") + F.col("file_start")).drop("_base")


def _checker(folder: str):
    """Arrow function: index rows sorted by file and position, with the crc32 of the ids read back."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        name = reader = None
        for rows in batches:
            sums = []
            for file, start, count in zip(
                rows.column("file").to_pylist(), rows.column("file_start").to_pylist(), rows.column("n_tokens").to_pylist(), strict=True
            ):
                if file != name:
                    name, path = file, f"{root}/{file}"
                    reader = PlaneReader(store.open_input_file(path), store.get_file_info(path).size)
                crc = 0
                for part in reader.read(start, count):
                    crc = zlib.crc32(np.ascontiguousarray(part, "<u4"), crc)
                sums.append(crc)
            kept = ["doc_id", "start", "n_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in kept), pa.array(sums, pa.int64())], [*kept, "ids_crc32"]
            )

    return check


def read_token_checksums(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the ids that the files hold for each index row."""
    spark = index.sparkSession
    ordered = index.repartition(partitions(spark), "file").sortWithinPartitions("file", "file_start")
    return ordered.mapInArrow(
        _checker(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def encode_to_bytes(ids: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = False) -> bytes:
    """A whole file in memory, for small tables and tests."""
    stream = io.BytesIO()
    writer = PlaneWriter(stream, block_ids, bits)
    writer.write(np.asarray(ids, np.uint32))
    writer.close()
    return stream.getvalue()
