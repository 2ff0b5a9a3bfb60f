import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tie string, key int, n string, cid string"


@pytest.fixture(scope="session")
def spark():
    from firstborn.session import local_session

    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text[, lang, source]) as a documents table with extra columns of clashing names."""

    def make(rows):
        full = []
        for doc_id, text, *rest in rows:
            lang, source = (*rest, *("en", "s0")[len(rest) :])[:2]
            full.append((doc_id, text, lang, source, len(text or ""), "x", 7, "y", "z"))
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, ties, one long text."""
    long = " ".join(f"w{i % 997} x{i % 13}" for i in range(20_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven"), (4, "one two three four five six seven"),
        (5, "one two three four five six seven"), (5, "another text with the same id as the one before it, a little longer"),
        (None, "a text that nobody gave an id, though it has quite a few words in it"), (6, long, None, None), (7, "é ü 日本 🙂  two  spaces\r\nand lines\n\n"),
        (8, "ONE two three four five six seven", "de", None), (9, "x"),
    ]
