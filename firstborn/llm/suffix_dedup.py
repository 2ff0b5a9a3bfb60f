"""Removing repeated byte strings with suffix arrays.

Every window of ``length`` bytes that also starts in a document of smaller doc_id is covered.
Equal windows are brought together by content: the least hash of the short grams inside a
window (its minimizer) depends on the window alone, and so does the longer gram that reaches
from the minimizer to the side where the window has more text (33 of 50 bytes).  Windows whose
longer gram only one document has need no look at all: a short gram is shared by chance ever
more often as the corpus grows, a long one hardly.  The others are sent, as segments of text,
to the bucket of their minimizer.  A bucket sorts its segments' suffixes by refinement of ranks
(8, 16, 32, then ``length`` bytes), takes common prefixes of neighbours from the ranks, and so
finds the least doc_id of every window.  Text above SHARD_BYTES is cut into shards with a suffix
array each, merged by binary search.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..session import drop_tables, persist_reliably, scratch_path, table_scope
from .common import partitions, whole_text

LENGTH = 50
GRAM = 16
#: Windows whose minimizers are found in one go.
SLICE = 1 << 17
#: Text of one suffix array.
SHARD_BYTES = 3 << 20
#: Text of a shard of documents, text per bucket of grams, and text sent to a bucket of segments.
#: Every shard sends a row to every bucket, so rows must stay large however much text there is.
TEXT_SHARD = 8 << 20
GRAM_BUCKET = 16 << 20
SEGMENT_BUCKET = 16 << 20
#: Shards and buckets of little text (1 MB at least) are smaller, for so many there may be.
LEAST_TEXT = 1 << 20
SPREAD = 128
#: Parts of a bucket of segments, and text of the parts judged at a time.
PARTS = 16
PARTS_TEXT = 1 << 20
#: Text sent for a gram that several documents have.
SENT_BYTES = 48

_STEP = 0x9E3779B97F4A7C15
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.full(count, base, np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


_UP = _powers(_STEP, SLICE + LENGTH + 64)
_DOWN = _powers(pow(_STEP, -1, 1 << 64), SLICE + LENGTH + 64)

#: A minimizer is a hash with its place in the slice below, so that the first of equal ones is the least.
_PLACE = np.uint64(SLICE.bit_length())


def _gram_hash(sums: np.ndarray, at, width: int) -> np.ndarray:
    return _mix((sums[at + width] - sums[at]) * _DOWN[at])


def minimizers(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``length`` bytes the least hash of its grams, with its place; and prefix sums for hashes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    if n < length:
        return np.zeros(0, np.uint64), sums
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], dtype=np.uint64, out=sums[1:])
    least = _mix((sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1])
    least >>= _PLACE
    least <<= _PLACE
    least |= np.arange(len(least), dtype=np.uint64)
    wide, width = 1, length - gram + 1
    while 2 * wide <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    return np.minimum(least[: n - length + 1], least[width - wide :]) if wide < width else least, sums


def runs_of(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows of one text with one minimizer and one side: (text number, first window, windows, minimizer, long gram)."""
    number, group, held = 0, [], 0
    for text in [*texts, None]:
        if text is None or held + len(text) > SLICE:
            if group:
                yield _runs(group, number - len(group), 0, length)
            group, held = [], 0
        if text is None:
            break
        if len(text) > SLICE:  # slices overlap so that every window is in one of them
            for start in range(0, len(text) - length + 1, SLICE):
                yield _runs([text[start : start + SLICE + length - 1]], number, start, length)
        else:
            group.append(text)
            held += len(text)
        number += 1
        if len(text) > SLICE:
            group, held = [], 0


def _runs(texts: list[bytes], first: int, offset: int, length: int):
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    least, sums = minimizers(data, length)
    ends = np.cumsum(sizes)
    n = len(least)
    begin = np.arange(n)
    # Windows that run on into the next text count for nothing.
    inside = np.ones(n, bool)
    for end in ends[:-1].tolist():
        inside[max(end - length + 1, 0) : end] = False
    # Of the bytes around the minimizer the window holds at least this many more on one side.
    half = (length - GRAM) // 2
    place = (least & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    left = place - begin >= half
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | (left[1:] != left[:-1]) | ~inside[:-1]
    at = np.flatnonzero(new)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])
    count = total[np.concatenate([at[1:], [n]])] - total[at] if len(at) else at
    texts_at = np.searchsorted(ends, at, side="right")
    grams = _gram_hash(sums, np.where(left[at], place[at] - half, place[at]), GRAM + half)
    return first + texts_at, at - (ends - sizes)[texts_at] + offset, count, least[at] >> _PLACE, grams


def _all_runs(texts: list[bytes], length: int):
    parts = list(runs_of(texts, length))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --- suffix arrays ---


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(order, ranks): suffixes sorted by their first ``depth`` bytes, and the ranks by 8, 16, ... bytes.

    Refinement as by Larsson and Sadakane: a suffix's rank by 2h bytes comes from its rank by
    h bytes and that of the suffix h further on; only groups of equal rank are sorted again.
    Past the end counts as the least byte.
    """
    n = len(data)
    key = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        key = key[:-width] << np.uint64(8 * width) | key[width:]
    key = key[:n]
    order = np.argsort(key)
    rank = _rank(key[order], order)
    ranks, step = {8: rank}, 8
    while step < depth:
        ahead = min(step, depth - step)
        starts = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1], [True]]))
        sizes = np.diff(starts)
        many = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(many)
        new = rank.copy()
        if len(at):
            where = order[at]
            further = np.where(where + ahead < n, rank[np.minimum(where + ahead, n - 1)].astype(np.int64) + 1, 0)
            pair = rank[where].astype(np.int64) * (n + 1) + further
            inner = np.argsort(pair)
            order[at] = where[inner]
            pair = pair[inner]
            fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
            new[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        rank, step = new, step + ahead
        ranks[step] = rank
    return order, ranks


def _rank(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place of the first equal key, for every key."""
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0)).astype(np.int32)
    rank = np.empty(len(order), np.int32)
    rank[order] = first
    return rank


def window_owners(segments: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment (starts, owner): runs of its windows and the least owner of an equal window in any segment."""
    cuts, starts, owner = owner_runs(b"".join(segments), np.array([len(s) for s in segments], np.int64), owners, length)
    return [(starts[a:b], owner[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def owner_runs(text: bytes, sizes: np.ndarray, owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, starts, owner) of segments laid end to end: runs cuts[i] to cuts[i + 1] are those of segment i."""
    data = np.frombuffer(text, np.uint8)
    ends = np.cumsum(sizes)
    shards, begin = [], 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + SHARD_BYTES, side="right")))
        shards.append((begin, end))
        begin = end
    solved = [
        _shard_owners(data[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b], owners[a:b], length, len(shards) > 1) for a, b in shards
    ]
    if len(shards) > 1:
        # Each shard's sorted windows are looked up in every other's by binary search.
        for i, (_, keys, _) in enumerate(solved):
            for j, (_, other, least_other) in enumerate(solved):
                if i != j and len(other):
                    at = np.minimum(np.searchsorted(other, keys), len(other) - 1)
                    same = other[at] == keys
                    solved[i] = (solved[i][0], keys, np.where(same, np.minimum(solved[i][2], least_other[at]), solved[i][2]))
    found = np.concatenate([least[group] for group, _, least in solved] or [np.zeros(0, np.int64)])
    counts = sizes - length + 1
    begin = np.cumsum(counts) - counts
    fresh = np.ones(len(found), bool)
    fresh[1:] = found[1:] != found[:-1]
    fresh[begin] = True
    at = np.flatnonzero(fresh)
    cuts = np.searchsorted(at, begin)
    cuts = np.append(cuts, len(at))
    return cuts, at - np.repeat(begin, np.diff(cuts)), found[at]


def _shard_owners(data, sizes, owners, length, with_keys):
    """(group of every window, the groups' windows as sorted keys, least owner of every group)."""
    ends = np.cumsum(sizes)
    counts = sizes - length + 1
    segment = np.repeat(np.arange(len(sizes)), counts)
    starts = np.arange(len(segment)) + np.repeat(ends - sizes - np.cumsum(counts) + counts, counts)
    # The last refinement is of the windows only, not of every suffix: a window's first
    # ``depth`` bytes, and as many up to its end.
    depth = 8 << ((length // 8).bit_length() - 1)
    _, ranks = suffix_ranks(data, depth)
    # Neighbours in the suffix array share a prefix of the length if their ranks by it agree.
    rank = ranks[depth]
    pair = rank[starts].astype(np.int64) * (len(data) + 1) + rank[starts + length - depth]
    order = np.argsort(pair)
    pair = pair[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    least = np.minimum.reduceat(owners[segment[order]], first)
    keys = np.zeros(0, f"S{length}")
    if with_keys:
        keys = np.ascontiguousarray(data[starts[order[first]][:, None] + np.arange(length)]).view(f"S{length}").ravel()
    return group, keys, least


# --- the job ---


_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(data: bytes) -> bytes:
    return _ZSTD.compress(data)


def _unpack(blob: bytes) -> bytes:
    return _UNZSTD.decompress(blob)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


_GRAMS = "shard int, bucket int, grams binary, several binary"


def _send_grams(buckets: int, length: int):
    """A shard's distinct long grams by bucket, and which of them several of its documents have.

    Of a gram its bucket and 32 bits are sent: two grams that agree in them by chance only cost
    a look at their windows.
    """

    def send(table: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("several", pa.binary())])
        number, _, _, _, grams = _all_runs(table.column("text").to_pylist(), length)
        if not len(grams):
            return schema.empty_table()
        order = np.argsort(grams)
        grams, number = grams[order], number[order]
        cuts = _cuts(grams)[:-1]
        apart = np.zeros(len(grams), bool)
        apart[1:] = (grams[1:] == grams[:-1]) & (number[1:] != number[:-1])
        several = np.logical_or.reduceat(apart, cuts)
        grams = grams[cuts]
        bucket, short = _bucket_of(grams, buckets), grams.astype(np.uint32)
        shard = table.column("shard")[0].as_py()
        at = _cuts(bucket).tolist()
        rows = [
            (shard, b, short[i:j].tobytes(), np.packbits(several[i:j]).tobytes()) for b, i, j in zip(bucket[at[:-1]].tolist(), at[:-1], at[1:], strict=True)
        ]
        return _table(rows, schema)

    return send


def _shared_grams(table: pa.Table) -> pa.Table:
    """Tell every shard which of its grams another document has too."""
    values = [np.frombuffer(x, np.uint32) for x in table.column("grams").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool) for x, v in zip(table.column("several").to_pylist(), values, strict=True)]
    sizes = np.array([len(v) for v in values], np.int64)
    # Sorted with their places below, so that the answer goes back without a search.
    every = np.concatenate(values).astype(np.uint64) << np.uint64(32) | np.arange(int(sizes.sum()), dtype=np.uint64)
    every.sort()
    place = (every & np.uint64(0xFFFFFFFF)).astype(np.int64)
    every >>= np.uint64(32)
    cuts = _cuts(every)
    known = (np.diff(cuts) > 1) | np.logical_or.reduceat(np.concatenate(several)[place], cuts[:-1])
    mine = np.empty(len(place), bool)
    mine[place] = np.repeat(known, np.diff(cuts))
    ends = np.cumsum(sizes)
    rows = []
    for shard, bucket, value, end in zip(table.column("shard").to_pylist(), table.column("bucket").to_pylist(), values, ends.tolist(), strict=True):
        kept = value[mine[end - len(value) : end]]
        if len(kept):
            rows.append((shard, bucket, kept.tobytes()))
    return _table(rows, pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary())]))


_SENT = pa.schema(
    [
        ("shard", pa.int32()), ("bucket", pa.int32()), ("parts", pa.binary()), ("sizes", pa.binary()), ("owners", pa.binary()),
        ("text", pa.binary()), ("places", pa.binary()),
    ]
)


def _send_segments(gram_buckets: int, buckets: int, length: int):
    """A shard's distinct segments by bucket, in order of its parts, with their least doc_id; and where they stand."""

    def send(texts: pa.Table, grams: pa.Table) -> pa.Table:
        if not len(texts) or not len(grams):
            return _SENT.empty_table()
        known = np.concatenate(
            [
                np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32)
                for b, x in zip(grams.column("bucket").to_pylist(), grams.column("grams").to_pylist(), strict=True)
            ]
        )
        known.sort()
        docs = np.array(texts.column("doc_id").to_pylist(), np.int64)
        raw = texts.column("text").to_pylist()
        number, first, count, least, gram = _all_runs(raw, length)
        gram = gram & np.uint64(0xFFFFFFFF) | _bucket_of(gram, gram_buckets).astype(np.uint64) << np.uint64(32)
        pick = np.flatnonzero(known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram)
        number, first, count, least = number[pick], first[pick], count[pick], least[pick]
        # Runs that go on from one another under one minimizer are one segment.
        fresh = np.ones(len(pick), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (least[1:] != least[:-1]) | (first[1:] != first[:-1] + count[:-1])
        at = np.flatnonzero(fresh)
        number, first, least, count = number[at], first[at], least[at], np.add.reduceat(count, at)
        hashes = _mix(least)
        bucket, part = _bucket_of(hashes, buckets), (hashes & np.uint64(PARTS - 1)).astype(np.int64)
        order = np.lexsort((part, bucket))
        number, first, count, bucket, part = number[order], first[order], count[order], bucket[order], part[order]
        ends = first + count + length - 1
        owner = docs[number]
        cuts = _cuts(bucket).tolist()
        rows, shard = [], texts.column("shard")[0].as_py()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            # Equal segments have the same part, so distinct ones are in order of parts as well.
            ids: dict[bytes, int] = {}
            which = np.array(
                [ids.setdefault(raw[t][a:b], len(ids)) for t, a, b in zip(number[i:j].tolist(), first[i:j].tolist(), ends[i:j].tolist(), strict=True)],
                np.int32,
            )
            owners = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(owners, which, owner[i:j])
            parts = np.zeros(len(ids), np.int64)
            parts[which] = part[i:j]
            rows.append(
                (
                    shard, int(bucket[i]), np.bincount(parts, minlength=PARTS).astype(np.int32).tobytes(),
                    _pack(np.fromiter(map(len, ids), np.int32, len(ids)).tobytes()), _pack(owners.tobytes()), _pack(b"".join(ids)),
                    _pack(np.stack([number[i:j], first[i:j], which]).astype(np.int32).tobytes()),
                )
            )
        return _table(rows, _SENT)

    return send


_FOUND = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("cuts", pa.binary()), ("starts", pa.binary()), ("owner", pa.binary())])


def _spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] of them, then those of first[1], ..."""
    return np.arange(int(counts.sum())) + np.repeat(first - np.cumsum(counts) + counts, counts)


def _together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of parts with PARTS_TEXT of text, or of one part."""
    i = 0
    for j in range(1, len(sizes) + 1):
        if j == len(sizes) or sizes[i : j + 1].sum() > PARTS_TEXT:
            yield i, j
            i = j


def _judge_segments(length: int):
    """For every shard's segments: the runs of windows and the least doc_id of each."""

    def judge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.int32) for x in table.column("parts").to_pylist()]
        sizes = [np.frombuffer(_unpack(x), np.int32) for x in table.column("sizes").to_pylist()]
        owners = [np.frombuffer(_unpack(x), np.int64) for x in table.column("owners").to_pylist()]
        texts = [_unpack(x) for x in table.column("text").to_pylist()]
        ends = [np.cumsum(x, dtype=np.int64) for x in sizes]
        places = [np.concatenate([[0], x])[np.concatenate([[0], np.cumsum(n)])] for x, n in zip(ends, parts, strict=True)]
        begins = [np.concatenate([[0], np.cumsum(x)]).tolist() for x in parts]
        many, starts, owner, rows_of = [], [], [], []
        for i, j in _together(np.diff(places, axis=1).sum(axis=0)):
            ids: dict[bytes, int] = {}
            mine, least, counts = [], [], []
            for text, end, own, begin, place in zip(texts, ends, owners, begins, places, strict=True):
                at = int(place[i])
                a, b = begin[i], begin[j]
                for to in end[a:b].tolist():
                    mine.append(ids.setdefault(text[at:to], len(ids)))
                    at = to
                least.append(own[a:b])
                counts.append(b - a)
            if not ids:
                continue
            mine = np.array(mine, np.int64)
            own = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(own, mine, np.concatenate(least))
            cuts, start, found = owner_runs(b"".join(ids), np.fromiter(map(len, ids), np.int64, len(ids)), own, length)
            runs = np.diff(cuts)[mine]
            at = _spans(cuts[mine], runs)
            many.append(runs)
            starts.append(start[at].astype(np.int32))
            owner.append(found[at])
            rows_of.append(np.repeat(np.arange(len(texts)), counts))
        many, starts, owner, rows_of = (np.concatenate(x) for x in (many, starts, owner, rows_of))
        # From the order of parts to that of rows.
        order = np.argsort(rows_of, kind="stable")
        at = _spans((np.cumsum(many) - many)[order], many[order])
        many, starts, owner = many[order], starts[at], owner[at]
        cuts = np.concatenate([[0], np.cumsum(many)])
        rows, a = [], 0
        for shard, bucket, n in zip(table.column("shard").to_pylist(), table.column("bucket").to_pylist(), map(len, sizes), strict=True):
            inside = cuts[a : a + n + 1]
            i, j = inside[0], inside[-1]
            rows.append((shard, bucket, _pack((inside - i).astype(np.int32).tobytes()), _pack(starts[i:j].tobytes()), _pack(owner[i:j].tobytes())))
            a += n
        return _table(rows, _FOUND)

    return judge


_REMOVED = pa.schema(
    [("doc_id", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))]
)


def _batches(sizes: list[int], most: int) -> Iterator[range]:
    i = held = 0
    for j, size in enumerate(sizes):
        if j > i and held + size > most:
            yield range(i, j)
            i, held = j, 0
        held += size
    if sizes:
        yield range(i, len(sizes))


def _apply(length: int, with_text: bool):
    """Cover the windows of smaller documents; the documents that lose bytes."""

    def apply(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not len(texts) or not len(found):
            return _REMOVED.empty_table()
        docs = np.array(texts.column("doc_id").to_pylist(), np.int64)
        sizes = np.array([len(x) for x in texts.column("text").to_pylist()], np.int64)
        base = np.cumsum(sizes) - sizes
        edges = np.zeros(int(sizes.sum()) + 1, np.int32)
        # Rows are taken together up to so many runs.
        for rows in _batches([len(x) for x in found.column("owner").to_pylist()], 1 << 20):
            part = found.slice(rows.start, len(rows))
            read = lambda name, kind: [np.frombuffer(_unpack(x), kind) for x in part.column(name).to_pylist()]  # noqa: B023, E731
            counts = [np.diff(x) for x in read("cuts", np.int32)]
            starts, owner = np.concatenate(read("starts", np.int32)), np.concatenate(read("owner", np.int64))
            windows = np.concatenate(read("sizes", np.int32)) - length + 1
            places = [x.reshape(3, -1) for x in read("places", np.int32)]
            which = np.repeat(np.cumsum([0, *map(len, counts[:-1])]), [x.shape[1] for x in places])
            text, first, segment = np.concatenate(places, axis=1)
            segment = segment + which
            counts = np.concatenate(counts)
            begin = np.cumsum(counts) - counts
            ends = np.append(starts[1:], 0).astype(np.int64)
            ends[begin + counts - 1] = windows
            runs = counts[segment]
            run = _spans(begin[segment], runs)
            hit = owner[run] < np.repeat(docs[text], runs)
            run, at = run[hit], np.repeat(base[text] + first, runs)[hit]
            np.add.at(edges, at + starts[run], 1)
            np.subtract.at(edges, at + ends[run] + length - 1, 1)
        gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
        rows = []
        hashes, raw = texts.column("sha").to_pylist(), texts.column("text").to_pylist()
        touched = np.flatnonzero(np.add.reduceat(gone, base) > 0) if len(gone) else []
        for t in touched:
            mask = gone[base[t] : base[t] + sizes[t]]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            kept = np.frombuffer(raw[t], np.uint8)[~mask].tobytes()
            rows.append(
                (int(docs[t]), hashes[t], int(mask.sum()), len(turns) // 2, kept if with_text else hashlib.sha256(kept).hexdigest().encode(), turns.tolist())
            )
        return _table(rows, _REMOVED)

    return apply


def _dealt(size: int, text: int) -> int:
    """Shards or buckets for so many bytes."""
    return max(1, size // text, min(size // LEAST_TEXT, SPREAD))


def repeated_spans(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, spans of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller doc_id; strings never cross documents.  spans lists starts and ends of the maximal
    removed runs; kept is what remains: the bytes if ``with_text``, else their sha256 in
    lowercase hex (as bytes).  A null text is empty.  Rows with a null doc_id are neither
    smaller nor larger than others: they lose nothing and take nothing.  Rows with equal ids do
    not compare with one another.  Texts shorter than ``length`` stay.  An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"))
    sha = F.sha2("text", 256)
    rows = persist_reliably(whole.select("doc_id", sha.alias("sha"), F.length("text").cast("bigint").alias("n_bytes")))
    # Equal texts: all but the least id lose everything.
    least = persist_reliably(rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("_copies")))
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    shards, gram_buckets = _dealt(size, TEXT_SHARD), _dealt(size, GRAM_BUCKET)
    # A task sorts and holds the texts of a few shards, however few partitions the session has.
    many = max(partitions(spark), shards // 8)
    first = whole.withColumn("sha", sha).filter(F.length("text") >= length)
    firsts = least.filter("least is not null").select("sha", F.col("least").alias("doc_id"))
    placed = (
        first.join(firsts, ["sha", "doc_id"])
        .dropDuplicates(["sha", "doc_id"])
        .withColumn("shard", F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int"))
        .select("shard", "doc_id", "sha", "text")
    )
    name = f"texts_{uuid.uuid4().hex}"
    path = scratch_path(spark, "texts")
    placed.repartition(many, "shard").write.bucketBy(many, "shard").option("compression", "zstd").option("path", path).format(
        "parquet"
    ).saveAsTable(name)
    texts = spark.table(name)

    with table_scope() as spent:
        grams = texts.groupBy("shard").applyInArrow(_send_grams(gram_buckets, length), _GRAMS)
        shared = persist_reliably(grams.groupBy("bucket").applyInArrow(_shared_grams, "shard int, bucket int, grams binary"))
        several = shared.agg(F.sum(F.length("grams"))).first()[0] or 0
        buckets = _dealt(several // 4 * SENT_BYTES, SEGMENT_BUCKET)
        sent = persist_reliably(
            texts.groupBy("shard")
            .cogroup(shared.groupBy("shard"))
            .applyInArrow(
                _send_segments(gram_buckets, buckets, length),
                "shard int, bucket int, parts binary, sizes binary, owners binary, text binary, places binary",
            )
        )
        found = persist_reliably(
            sent.drop("places").groupBy("bucket").applyInArrow(_judge_segments(length), "shard int, bucket int, cuts binary, starts binary, owner binary")
        )
    answered = sent.select("shard", "bucket", "sizes", "places").join(found, ["shard", "bucket"])
    removed = persist_reliably(
        texts.groupBy("shard")
        .cogroup(answered.groupBy("shard"))
        .applyInArrow(
            _apply(length, with_text), "doc_id bigint, sha string, n_removed bigint, n_spans bigint, kept binary, spans array<bigint>"
        )
    )
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    drop_tables(spark, [path, *spent])
    copy = (F.col("least") < F.col("doc_id")) & (F.col("n_bytes") >= length)
    nothing = F.lit(b"" if with_text else hashlib.sha256(b"").hexdigest().encode())
    # Thousands of copies share one text.
    judged = skew_join(rows, least, ["sha"], size="_copies", spread="doc_id").join(removed, ["sha", "doc_id"], "left")
    out = judged.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        # Null stands for the whole text where texts are asked for.
        F.when(copy, nothing).otherwise(F.coalesce("kept", F.lit(None).cast("binary") if with_text else F.col("sha").cast("binary"))).alias("kept"),
        F.when(copy, F.array(F.lit(0).cast("bigint"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>"))).alias("spans"),
    )
    return out
