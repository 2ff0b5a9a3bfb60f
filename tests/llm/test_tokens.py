import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from firstborn.llm.piece_codec import FAN, FEW, PieceModel, chunk_states, decode_pieces, encode_pieces, product, scan
from firstborn.llm.token_counts import pieces, token_counts
from firstborn.llm.token_files import PlaneReader, encode_to_bytes, read_token_checksums, write_token_files
from firstborn.session import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
NASTY = [
    (20, "a  b   c\n \n d<|endoftext|> e <|endoftext|>  f  g\x1c h i"), (21, "it's I'll they've  'tis"), (22, "   lead and trail   "),
    (23, "1234567890" * 30), (24, "\t\ttabs\t and\x0bverticals\x0c ok"), (25, "ΑΣ ΟΔΟΣ é ́x"), (26, "▁ ▁▁ literal marks"), (27, "nul\x00byte ok"),
]


def test_counts_agree_with_the_library(frame, odd_rows):
    rows = [*odd_rows, *NASTY]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts(frame(rows), BPE, batch_bytes=200).collect())
    library = Tokenizer.from_file(BPE)
    want = sorted((d or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)
    assert got == want
    assert token_counts(frame([]), BPE).count() == 0


@given(st.text(alphabet=" \n\tab.é'<|>", max_size=60))
@settings(max_examples=200, deadline=None)
def test_pieces_add_up(text):
    library = Tokenizer.from_file(BPE) if not hasattr(test_pieces_add_up, "t") else test_pieces_add_up.t
    test_pieces_add_up.t = library
    parts = pieces(text)
    assert "".join(parts) == text
    assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [True, False])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(3), rng.integers(0, 1 << 32, 1000), rng.integers(0, 49408, 5000), np.arange(7)):
        raw = encode_to_bytes(np.asarray(ids, np.uint32), 64, bits)
        import io

        reader = PlaneReader(io.BytesIO(raw), len(raw))
        back = np.concatenate([np.zeros(0, np.uint32), *reader.read(0, len(ids))])
        assert (back == ids).all()
        if len(ids) > 200:
            assert (np.concatenate(list(reader.read(130, 70))) == ids[130:200]).all()
    with pytest.raises(ValueError):
        PlaneReader(io.BytesIO(raw[:-1]), len(raw) - 1)


@pytest.mark.parametrize("bits", [True, False])
def test_token_files(spark, frame, odd_rows, bits):
    rows = [*odd_rows, *NASTY]
    folder = scratch_path(spark, "ids")
    index = write_token_files(frame(rows), folder, WORD, 1, block_ids=100, bits=bits)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_checksums(index, folder).collect())
    starts = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in index.collect())
    library = Tokenizer.from_file(WORD)
    want = []
    for d, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((-1 if d is None else d, len(ids), zlib.crc32(np.array(ids, "<u4"))))
    assert got == sorted(want)
    end = 0
    for start, n, _ in starts:
        assert start == end
        end += n
    assert [s[2] for s in starts] == sorted(s[2] for s in starts)
    empty = write_token_files(frame([]), scratch_path(spark, "ids"), WORD, 1)
    assert read_token_checksums(empty, folder).count() == 0


@pytest.mark.parametrize("chunk", [40, 1 << 16])
def test_pieces_agree_with_the_library(frame, odd_rows, chunk):
    rows = [*odd_rows, *NASTY, (30, "nospacesatall" * 40), (31, " " * 100)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    encoded = encode_pieces(frame(rows), PIECE, chunk=chunk)
    got = sorted((r.doc_id or -1, r.ids or []) for r in encoded.collect())
    assert got == sorted((d or -1, library.encode(t or "")) for d, t, *_ in rows)
    texts = sorted((r.doc_id or -1, r.text) for r in decode_pieces(encoded, PIECE).collect())
    # A literal space mark reads as a space, as in the library.
    assert texts == sorted((d or -1, (t or "").replace("▁", " ")) for d, t, *_ in rows)
    assert encode_pieces(frame([]), PIECE).count() == 0


def test_chunk_matrices_multiply():
    model = PieceModel(PIECE)
    text = model.normal("the quick brownfoxjumpsoverthelazydog and 日本語 again " * 3)
    cut = [text[i : i + 23] for i in range(0, len(text), 23)]
    around = lambda i: (text[max(0, 23 * i - 16) : 23 * i], cut[i], text[23 * i + 23 : 23 * i + 39])
    matrices = [model.matrix(*around(i), i == 0, i == len(cut) - 1) for i in range(len(cut))]
    left = matrices[0]
    for m in matrices[1:]:
        left = product(left, m)
    right = matrices[-1]
    for m in reversed(matrices[:-1]):
        right = product(m, right)
    assert left == right and len(left) == 1
    states = scan(matrices)
    joined = [p for i, s in enumerate(states) for p in model.trace(*around(i), *s)]
    assert joined == model.path(text)


def test_states_come_down_the_tree(spark):
    model = PieceModel(PIECE)
    text = model.normal("the quick brownfoxjumpsoverthelazydog and 日本語 again " * 50)
    cut = [text[i : i + 13] for i in range(0, len(text), 13)]
    assert len(cut) > 3 * FAN
    around = lambda i: (text[max(0, 13 * i - 16) : 13 * i], cut[i], text[13 * i + 13 : 13 * i + 29])
    matrices = [model.matrix(*around(i), i == 0, i == len(cut) - 1) for i in range(len(cut))]
    rows = [(7, n, [i for i, _ in m], [j for _, j in m]) for n, m in enumerate(matrices)]
    table = spark.createDataFrame(rows, "key bigint, chunk int, enter array<int>, leave array<int>")
    got = [(r.enter, r.leave) for r in chunk_states(table, 13).orderBy("chunk").collect()]
    assert got == scan(matrices)


def test_a_text_of_a_thousand_chunks(frame):
    text = "".join(chr(97 + i * i % 23) + (" " if i % 7 == 0 else "") for i in range(16_000)) + "日本語 end"
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    (row,) = encode_pieces(frame([(1, text)]), PIECE, chunk=16).collect()
    assert row.ids == library.encode(text)


@given(st.lists(st.text(alphabet="▁aeinrstbè日\U0001f600.\n9", min_size=1, max_size=14), min_size=FEW + 1, max_size=60, unique=True))
@settings(max_examples=60, deadline=None)
def test_words_side_by_side(words):
    model = test_words_side_by_side.__dict__.setdefault("model", PieceModel(PIECE))
    found = dict(model.encode_words(words))
    assert set(found) == set(words)
    assert all(np.frombuffer(found[w], "<i4").tolist() == model.to_ids(model.path(w)) for w in words)


def test_words_met_again_are_remembered():
    model = PieceModel(PIECE)
    model.learn({f"word{i}" for i in range(40)}, 30)
    model.learn({"word1", "other"}, 30)
    assert set(model.words) == {"word1", "other"} and "word2" in model.older
    model.learn({"word2"}, 30)
    assert "word2" in model.words
