"""Every dealt operator and the pipeline are registered and give the columns of their contract."""

import pytest

import __spark_entry__ as contract

COLUMNS = {
    "op1_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op5_": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op7_": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
        "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
    },
    "op8_": {"doc_id": "bigint", "n_pieces": "bigint"},
    "op9_": {"doc_id": "bigint", "n_removed": "int"},
    "op11_": {
        "doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string",
        "verified": "boolean",
    },
    "op12_": {
        "doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string",
        "labels": "string", "score": "double",
    },
    "op13_": {
        "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint",
        "negative_score": "bigint",
    },
    "op10_": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_query(spark, prefix):
    (name,) = [q for q in contract.queries() if q.startswith(prefix)]
    frame = contract.queries()[name](spark, "/root/testdata/sf0.001")
    if prefix == "op13_":
        assert frame.count() > 0
        return
    table = "embeddings" if prefix == "op10_" else "documents"
    assert dict(frame.dtypes).items() >= COLUMNS[prefix].items()
    assert frame.count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()


def test_pipeline_is_registered(spark):
    assert "pipeline" in contract.queries()
