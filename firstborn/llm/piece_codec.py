"""SentencePiece BPE encoding and decoding by a max-plus scan over boundary states.

A segmentation is the BPE encoding exactly if every two neighbouring pieces are
*compatible*: encoded together they come out as the same two pieces.  Encoding is then a
best path in a lattice of (position, last piece) with weight 0 for compatible neighbours
and minus infinity for others.  A text that is cut at arbitrary places is encoded chunk by
chunk: the state at a cut is the piece that reaches or crosses it, a chunk is a max-plus
matrix from entry to exit states, the matrices of a document multiply associatively, and
each chunk is traced back on its own once its entry and exit states are known.

No piece joins a non-space to a following space mark, so words are independent parts of
the lattice: their state is always the same.  Ordinary texts are encoded word by word with
a memory of words seen; the paths of new words are searched side by side in numpy.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_reliably
from .common import partitions, whole_text

MARK = "▁"
#: Characters above which a text is cut into chunks of this size that are encoded in parallel.
CHUNK = 1 << 16
#: Distinct words a worker meets before it forgets those not met since as many before.
REMEMBERED = 200_000
#: Letters of new words whose paths are searched side by side.
SIDE_BY_SIDE = 200_000
#: So many unfinished words are searched one by one.
FEW = 24
#: Numbers of letters that no piece has begin here; ids of pieces are smaller.
UNKNOWN = 1 << 17
#: Slots for remembered pairs, as a power of two.
PAIR_BITS = 20
#: Pairs of pieces of which a worker remembers whether they are compatible.
REMEMBERED_PAIRS = 500_000
#: Neighbouring chunks, or blocks of chunks, whose matrices become the matrix of one block.
FAN = 64
#: No text has more characters than a Java string.
LONGEST_TEXT = 1 << 31

START = -1
FOREVER = float("inf")

# Piece kinds of the model file (fixed values).
NORMAL, BYTE = 1, 6


class PieceModel:
    """The pieces of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("only BPE models with identity normalisation are supported")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes_of = {}
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
        self.longest = max(map(len, self.ids))
        if self.longest > 31 or len(self.pieces) > UNKNOWN:
            raise ValueError("pieces of at most 31 letters, and at most 131,072 of them, are supported")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.endings: dict[str, list[tuple[str, float, float]]] = {}
        self.beginnings: dict[str, list[tuple[str, float, float]]] = {}
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        # Letters of the longest piece that begins with four given letters.
        self.reach: dict[str, int] = {}
        for piece in self.ids:
            if len(piece) > 3:
                self.reach[piece[:4]] = max(len(piece), self.reach.get(piece[:4], 4))
        # Pieces of two letters or more, each as one shared object.
        self.joined = {piece: piece for piece in self.rank if len(piece) > 1}
        self.raw = [self.bytes_of.get(i, p.encode()) for i, p in enumerate(self.pieces)]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", MARK) if text else ""

    # --- which pieces may stand side by side ---

    @lru_cache(maxsize=1 << 16)  # noqa: B019  one model per worker
    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes this piece when its letters are merged by rank."""
        parts = list(piece)
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, FOREVER) for a, b in zip(parts, parts[1:], strict=False)]
            at = int(np.argmin(ranks))
            if ranks[at] == FOREVER:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def edge(self, piece: str, last: bool) -> list[tuple[str, float, float]]:
        """The parts that stand at one end of the piece while it grows: (part, made at, used up at)."""
        known = self.endings if last else self.beginnings
        if piece not in known:
            chain, part = [], piece
            while True:
                chain.append(part)
                cut = self.halves(part) if len(part) > 1 else None
                if cut is None:
                    break
                part = cut[1] if last else cut[0]
            chain.reverse()
            made, clock = [], -1.0
            for part in chain:
                clock = max(clock, self.rank.get(part, -1.0)) if len(part) > 1 else -1.0
                made.append(clock)
            known[piece] = list(zip(chain, made, [*made[1:], FOREVER], strict=True))
        return known[piece]

    def compatible(self, left: str, right: str) -> bool:
        known = self.fits.setdefault(left, {})
        found = known.get(right)
        if found is None:
            found = known[right] = self._compatible(left, right)
            self.n_fits += 1
        return found

    def _compatible(self, left: str, right: str) -> bool:
        for x, made_x, used_x in self.edge(left, True):
            for y, made_y, used_y in self.edge(right, False):
                rank = self.rank.get(x + y)
                if rank is not None:
                    when = max(rank, made_x, made_y)
                    if when < used_x and when <= used_y:  # a tie goes to the left
                        return False
        return True

    # --- the lattice ---

    def path(self, text: str) -> list[str]:
        """The encoding of one word or any other text, from its start.

        A prefix has one encoding, so the last piece is known from the position alone: long
        pieces are tried first, and a position from which nothing fits is never tried again.
        """
        out: list[str] = []
        tried: list[int] = []
        dead: set[int] = set()
        joined, reach = self.joined, self.reach
        at, end, left = 0, len(text), ""
        length = min(reach.get(text[:4], 3), end)
        while at < end:
            fits = self.fits.get(left) if left else None
            while length:
                piece = text[at : at + length]
                if length > 1:
                    piece = joined.get(piece)
                if piece is not None and at + length not in dead:
                    if not left:
                        break
                    good = fits.get(piece) if fits is not None else None
                    if good is None:
                        good = self.compatible(left, piece)
                        fits = self.fits[left]
                    if good:
                        break
                length -= 1
            if length:
                out.append(piece)
                tried.append(length)
                at += length
                left = piece
                length = min(reach.get(text[at : at + 4], 3), end - at)
            else:
                dead.add(at)
                length = tried.pop() - 1
                at -= length + 1
                out.pop()
                left = out[-1] if out else ""
        return out

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            else:
                out.extend(int(self.byte_ids[b]) for b in piece.encode("utf-8", "replace"))
        return out

    def learn(self, words: set[str], remembered: int) -> None:
        """Have the ids of all these words in ``self.words``."""
        if len(self.words) > remembered:
            self.older, self.words = self.words, {}
        if self.n_fits > REMEMBERED_PAIRS:
            self.fits.clear()
            self.n_fits = 0
        new, held = [], 0
        for word in words.difference(self.words):
            found = self.older.get(word)
            if found is not None:
                self.words[word] = found
                continue
            new.append(word)
            held += len(word)
            if held > SIDE_BY_SIDE:
                self.words.update(self.encode_words(new))
                new, held = [], 0
        self.words.update(self.encode_words(new))

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Every word with its ids as little-endian 32-bit integers."""
        words = [w for w in words if w]
        found, chosen, ends = self._paths(words)
        which = np.flatnonzero(chosen >= 0)
        flat = chosen[which]
        at = np.searchsorted(which, np.concatenate([[0], ends]))
        raw = flat.astype("<i4").tobytes()
        letters_left = np.concatenate([[0], np.cumsum(flat >= UNKNOWN)])
        by_bytes = letters_left[at[1:]] - letters_left[at[:-1]]
        for word, a, b, done, odd in zip(words, (4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), found.tolist(), by_bytes.tolist(), strict=True):
            if done and not odd:
                yield word, raw[a:b]
            else:
                pieces = [self.name(n) for n in flat[a // 4 : b // 4].tolist()] if done else self.path(word)
                yield word, array("i", self.to_ids(pieces)).tobytes()

    def name(self, number: int) -> str:
        """The piece with this id, or the letter that no piece has."""
        return self.pieces[number] if number < UNKNOWN else chr(number - UNKNOWN)

    def _edges(self, letters: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids[at, n]: the piece of n + 1 letters that begins there; and a bit for each that exists.

        ``room`` is the number of letters from a place to the end of its word.
        """
        ids = np.full((len(letters), self.longest), -1, np.int32)
        ids[:, 0] = letters + UNKNOWN
        exists = np.ones(len(letters), np.int64)
        kind = self.letter_kind[letters]
        at = np.arange(len(letters))
        node = np.zeros(len(letters), np.int64)
        for depth in range(self.longest):
            inside = room[at] > depth
            at, node = at[inside], node[inside]
            key = node * self.n_kinds + kind[at + depth]
            place = np.minimum(np.searchsorted(self.branch_keys, key), len(self.branch_keys) - 1)
            found = self.branch_keys[place] == key
            at, node = at[found], self.branch_nodes[place[found]]
            piece = self.node_piece[node]
            whole = piece >= 0
            ids[at[whole], depth] = piece[whole]
            exists[at[whole]] |= 1 << depth
            if not len(at):
                break
        return ids, exists

    def _tree(self) -> None:
        """The pieces as a tree of letters in arrays: (node, kind of letter) -> node, node -> piece."""
        kinds = {c: n for n, c in enumerate(sorted(set().union(*self.ids)), 1)}
        self.n_kinds = len(kinds) + 1
        self.letter_kind = np.zeros(0x110000, np.int32)
        for letter, n in kinds.items():
            self.letter_kind[ord(letter)] = n
        nodes, branches = {"": 0}, {}
        for piece in self.ids:
            for size in range(1, len(piece) + 1):
                if piece[:size] not in nodes:
                    branches[nodes[piece[: size - 1]] * self.n_kinds + kinds[piece[size - 1]]] = nodes[piece[:size]] = len(nodes)
        self.branch_keys = np.array(sorted(branches), np.int64)
        self.branch_nodes = np.array([branches[k] for k in self.branch_keys.tolist()], np.int64)
        self.node_piece = np.full(len(nodes), -1, np.int32)
        for piece, number in self.ids.items():
            self.node_piece[nodes[piece]] = number
        # Answers of ``compatible`` by a hash of the pair; a later pair takes the place of an earlier one.
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 21 | right
        slot = (key * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> (63 - PAIR_BITS)
        out = self.pair_fits[slot]
        unknown = np.flatnonzero(self.pair_keys[slot] != key)
        if len(unknown):
            pairs, where = np.unique(key[unknown], return_inverse=True)
            answers = np.array([self.compatible(self.name(k >> 21), self.name(k & 0x1FFFFF)) for k in pairs.tolist()], bool)
            out[unknown] = answers[where]
            self.pair_keys[slot[unknown]] = key[unknown]
            self.pair_fits[slot[unknown]] = out[unknown]
        return out

    def _paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``path`` of many words at once, one step of every unfinished word at a time.

        Returns which words are done, the piece that begins at each letter of all words (-1
        for none), and where words end.  The last FEW unfinished words are left out.
        """
        if not hasattr(self, "node_piece"):
            self._tree()
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        done = np.zeros(len(words), bool)
        total = int(sizes.sum())
        chosen = np.full(total, -1, np.int32)
        if len(words) <= FEW:
            return done, chosen, ends
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        ids, left_over = self._edges(letters, np.repeat(ends, sizes) - np.arange(total))
        begins = ends - sizes
        back = np.full(total, -1, np.int64)
        dead = np.zeros(total + 1, bool)
        active = np.arange(len(words))
        place = begins.copy()
        while len(active) > FEW:
            at = place[active]
            bits = left_over[at]
            stuck = bits == 0
            if stuck.any():
                words_back, at_back = active[stuck], at[stuck]
                dead[at_back] = True
                before = back[at_back]
                chosen[before] = -1
                left_over[before] &= (1 << (at_back - before - 1)) - 1
                place[words_back] = before
                active, at, bits = active[~stuck], at[~stuck], bits[~stuck]
            length = np.frexp(bits.astype(np.float64))[1].astype(np.int64)
            to = at + length
            piece = ids[at, length - 1]
            good = ~dead[to] | (to == ends[active])
            inner = np.flatnonzero(good & (at > begins[active]))
            good[inner] = self._fit(chosen[back[at[inner]]], piece[inner])
            missed = at[~good]
            left_over[missed] ^= 1 << (length[~good] - 1)
            chosen[at[good]] = piece[good]
            finished = good & (to == ends[active])
            done[active[finished]] = True
            onward = good & ~finished
            back[to[onward]] = at[onward]
            place[active[onward]] = to[onward]
            going = active[~finished]
            active = np.concatenate([going, words_back]) if stuck.any() else going
        for word in active.tolist():
            chosen[begins[word] : ends[word]] = -1
        return done, chosen, ends

    # --- chunks ---

    def entries(self, before: str, after: str) -> list[int]:
        """States of a cut: every piece that reaches or crosses it, as 32 * letters beyond + length."""
        out = []
        around, cut = before + after, len(before)
        for beyond in range(min(self.longest, len(after) + 1)):
            for length in range(beyond + 1, min(self.longest, cut + beyond) + 1):
                piece = around[cut + beyond - length : cut + beyond]
                if length == 1 or piece in self.rank:
                    out.append(32 * beyond + length)
        return out

    def _run(self, before: str, body: str, after: str, states: list[int]):
        """nodes[i]: last piece at position i of the body and beyond -> (entry mask, where it began)."""
        around, cut, size = before + body + after, len(before), len(body)
        nodes: list[dict[str, tuple[int, str]]] = [{} for _ in range(size + self.longest + 1)]
        for number, state in enumerate(states):
            if state == START:
                nodes[0][""] = (nodes[0].get("", (0, ""))[0] | 1 << number, "")
            else:
                beyond, length = divmod(state, 32)
                piece = around[cut + beyond - length : cut + beyond]
                mask = nodes[beyond].get(piece, (0, ""))[0]
                nodes[beyond][piece] = (mask | 1 << number, "")
        for at in range(size):
            here = nodes[at]
            if not here:
                continue
            for length in range(1, self.longest + 1):
                if cut + at + length > len(around):
                    break
                piece = around[cut + at : cut + at + length]
                if length > 1 and piece not in self.rank:
                    continue
                for left, (mask, _) in here.items():
                    if not left or self.compatible(left, piece):
                        old = nodes[at + length].get(piece)
                        nodes[at + length][piece] = (mask | old[0] if old else mask, left)
        return nodes

    def matrix(self, before: str, body: str, after: str, first: bool, last: bool) -> list[tuple[int, int]]:
        """The (entry, exit) pairs of states that a path joins: the finite part of the max-plus matrix."""
        states = [START] if first else self.entries(before, body + after)
        nodes = self._run(before, body, after, states)
        size, out = len(body), []
        for beyond in range(1 if last else self.longest):
            for piece, (mask, _) in nodes[size + beyond].items():
                if len(piece) > beyond:
                    code = 32 * beyond + len(piece)
                    out.extend((s, code) for n, s in enumerate(states) if mask >> n & 1)
        return out

    def trace(self, before: str, body: str, after: str, entry: int, leave: int) -> list[str]:
        """The pieces that begin in the body, between two known states."""
        nodes = self._run(before, body, after, [entry])
        around, cut = before + body + after, len(before)
        beyond, length = divmod(leave, 32)
        at = len(body) + beyond
        piece = around[cut + at - length : cut + at]
        start = 0 if entry == START else entry // 32
        out = []
        while at > start:
            out.append(piece)
            left = nodes[at][piece][1]
            at, piece = at - len(piece), left
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def product(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Max-plus product of two 0 / minus infinity matrices given by their finite entries."""
    onward: dict[int, list[int]] = {}
    for i, j in b:
        onward.setdefault(i, []).append(j)
    return sorted({(i, k) for i, j in a for k in onward.get(j, ())})


def scan(matrices: list[list[tuple[int, int]]], enter: int = START, leave: int | None = None) -> list[tuple[int, int]]:
    """The entry and exit state of every chunk on the one path through all of them."""
    through: list[set[int]] = [{enter}]
    for matrix in matrices:
        through.append({j for i, j in matrix if i in through[-1]})
    if leave is None:
        (leave,) = through[-1]
    out = []
    for matrix, reached in zip(reversed(matrices), reversed(through[:-1]), strict=True):
        (before,) = {i for i, j in matrix if j == leave and i in reached}
        out.append((before, leave))
        leave = before
    return out[::-1]


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


_NEXT_WORD = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_DOUBLE = MARK + MARK


def words_of(text: str) -> list[str]:
    """A normalised text cut before every space mark that follows another character."""
    if _DOUBLE in text or not text.startswith(MARK):
        return _NEXT_WORD.split(text)
    return list(map(MARK.__add__, text[1:].split(MARK))) if text[-1] != MARK else _NEXT_WORD.split(text)


def _encode_words(path: str, remembered: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for rows in batches:
            texts = rows.column("text").to_pylist()
            at = 0
            while at < len(texts):
                begin, cut, held = at, [], 0
                while at < len(texts) and held < 1 << 19:
                    cut.append(words_of(model.normal(texts[at])) if texts[at] else [])
                    held += len(texts[at])
                    at += 1
                model.learn(set().union(*cut), remembered)
                known = model.words.__getitem__
                ids = [np.frombuffer(b"".join(map(known, words)), np.int32) for words in cut]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").slice(begin, at - begin), _lists(ids)], ["doc_id", "ids"]
                )

    return encode


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _cut(path: str, chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for rows in batches:
            for key, doc, raw in zip(*(rows.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                text = model.normal(raw)
                starts = range(0, len(text), chunk)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "key": key, "doc_id": doc, "chunk": number, "chunks": len(starts),
                            "before": text[max(0, at - model.longest) : at],
                            "body": text[at : at + chunk],
                            "after": text[at + chunk : at + chunk + model.longest],
                        }
                        for number, at in enumerate(starts)
                    ],
                    schema=pa.schema(
                        [("key", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32())]
                        + [(c, pa.string()) for c in ("before", "body", "after")]
                    ),
                )

    return cut


def _transfer(path: str):
    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model(path)
        for rows in batches:
            pairs = [
                model.matrix(r.before, r.body, r.after, r.chunk == 0, r.chunk == r.chunks - 1)
                for r in rows.itertuples()
            ]
            yield rows[["key", "chunk"]].assign(
                enter=[[i for i, _ in p] for p in pairs], leave=[[j for _, j in p] for p in pairs]
            )

    return transfer


_MATRIX = "key bigint, chunk int, enter array<int>, leave array<int>"
_STATES = "key bigint, chunk int, enter int, leave int"


def _pairs(row) -> list[tuple[int, int]]:
    return list(zip(row.enter, row.leave, strict=True))


def _combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The matrix of one block: its (at most FAN) neighbouring matrices multiplied."""
    whole = reduce(product, [_pairs(r) for r in rows.sort_values("chunk").itertuples()])
    return pd.DataFrame({"key": [key[0]], "chunk": [key[1]], "enter": [[i for i, _ in whole]], "leave": [[j for _, j in whole]]})


def _descend(rows: pd.DataFrame) -> pd.DataFrame:
    """States of a block's members from the states at its ends (block_enter, block_leave; null for a whole text)."""
    rows = rows.sort_values("chunk")
    enter, leave = rows.block_enter.iloc[0], rows.block_leave.iloc[0]
    ends = (START, None) if pd.isna(leave) else (int(enter), int(leave))
    states = scan([_pairs(r) for r in rows.itertuples()], *ends)
    return rows[["key", "chunk"]].assign(enter=[s[0] for s in states], leave=[s[1] for s in states])


def chunk_states(matrices: DataFrame, chunk: int, fan: int = FAN) -> DataFrame:
    """key, chunk, enter and leave of every chunk: a parallel scan over the matrices of all texts.

    Matrices are multiplied in blocks of ``fan`` neighbours, blocks in blocks, until the
    longest possible text is one block; states then go down the same tree.  No group has
    more than ``fan`` small matrices.
    """
    block = F.floor(F.col("chunk") / fan).cast("int").alias("block")
    levels, covered = [matrices], chunk * fan
    while covered < LONGEST_TEXT:
        levels.append(levels[-1].groupBy("key", block).applyInPandas(_combine, _MATRIX))
        covered *= fan
    states = None
    for level in reversed(levels):
        members = level.select("*", block)
        if states is None:
            ends = members.withColumns({"block_enter": F.lit(None).cast("int"), "block_leave": F.lit(None).cast("int")})
        else:
            above = states.select("key", F.col("chunk").alias("block"), F.col("enter").alias("block_enter"), F.col("leave").alias("block_leave"))
            ends = members.join(above, ["key", "block"])
        states = ends.groupBy("key", "block").applyInPandas(_descend, _STATES)
    return states


def _trace(path: str):
    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model(path)
        for rows in batches:
            yield rows[["key", "doc_id", "chunk"]].assign(
                ids=[model.to_ids(model.trace(r.before, r.body, r.after, r.enter, r.leave)) for r in rows.itertuples()]
            )

    return trace


def encode_pieces(docs: DataFrame, model_path: str, chunk: int = CHUNK, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text, as the model's own library gives them.

    A null or empty text has no ids.  Texts above ``chunk`` characters are cut into chunks
    spread over all tasks: chunk matrices, a parallel scan that combines them in blocks
    (``chunk_states``), and an independent trace per chunk.  Repeated rows and ids give a row each; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    small = rows.filter(F.length("text") <= chunk)
    short = small.mapInArrow(_encode_words(model_path, remembered), "doc_id bigint, ids array<int>")
    long = rows.filter(F.length("text") > chunk).withColumn("key", F.monotonically_increasing_id())
    chunks = persist_reliably(
        long.select("key", "doc_id", "text")
        .mapInArrow(
            _cut(model_path, chunk),
            "key bigint, doc_id bigint, chunk int, chunks int, before string, body string, after string",
        )
        .repartition(partitions(docs.sparkSession), "key", "chunk")
    )
    matrices = persist_reliably(chunks.mapInPandas(_transfer(model_path), _MATRIX))
    states = chunk_states(matrices, chunk)
    # A number of partitions of its own: chunks are few bytes but long work.
    spread = chunks.join(states, ["key", "chunk"]).repartition(partitions(docs.sparkSession), "key", "chunk")
    traced = spread.mapInPandas(_trace(model_path), "key bigint, doc_id bigint, chunk int, ids array<int>")
    joined = traced.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts")
    )
    return short.unionByName(joined.select("doc_id", F.flatten("parts.ids").alias("ids")))


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of encoded rows; byte pieces join to characters, space marks to spaces."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for rows in batches:
            texts = [model.decode(ids or []) for ids in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian 32-bit) and text_sha256 of the decoded text."""
    import hashlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for rows in batches:
            column = rows.column("ids")
            flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), "<i4")
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            parts = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([len(x) for x in parts], pa.int64()),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    pa.array([hashlib.sha256(model.decode(x.tolist()).encode()).hexdigest() for x in parts], pa.string()),
                ],
                ["doc_id", "n_pieces", "ids_crc32", "text_sha256"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        digest, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, text_sha256 string"
    )
