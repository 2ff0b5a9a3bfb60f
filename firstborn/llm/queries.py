"""Registered training-data queries: the digest of every operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import persist_reliably, scratch_path
from .common import ORACLES, QUERIES, query, table
from .hard_negatives import mine_hard_negatives
from .license_scan import scan_licenses
from .license_sql import LICENSES
from .line_dedup import dedup_lines
from .merkle import build_manifest, hex_text, parent_digest, prove
from .merkle_sql import MERKLE
from .mixing import mix, taken_words, word_sizes
from .near_dedup import near_duplicates
from .oracles import HARD_NEGATIVES, LINE_DEDUP, NEAR_DEDUP, VECTOR_DEDUP
from .outliers import quality_rules
from .piece_codec import digests, encode_pieces
from .quality import fit_quality, held_out, score_quality
from .suffix_dedup import repeated_spans
from .token_counts import token_counts
from .token_files import read_token_checksums, write_token_files
from .vector_dedup import link_vectors

__all__ = ["ORACLES", "QUERIES"]

#: Documents that score less are of low quality.
QUALITY_KEPT = 0.3


@query("op4_token_counts")
def op4_token_counts(spark, sf):
    counts = token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op6_token_files")
def op6_token_files(spark, sf):
    folder = scratch_path(spark, "token-files")
    index = write_token_files(
        table(spark, sf, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1
    )
    return read_token_checksums(index, folder)


@query("op8_piece_codec")
def op8_piece_codec(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return digests(encode_pieces(table(spark, sf, "documents"), path), path)


@query("op1_source_mixing")
def op1_source_mixing(spark, sf):
    sizes = persist_reliably(word_sizes(table(spark, sf, "documents")))
    return taken_words(*mix(sizes))


@query("op3_quality_scores")
def op3_quality_scores(spark, sf):
    docs = table(spark, sf, "documents")
    scores = score_quality(docs, fit_quality(docs, table(spark, sf, "labels")))
    return scores.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= QUALITY_KEPT).cast("int").alias("predicted")
    )


@query("op7_robust_outliers")
def op7_robust_outliers(spark, sf):
    return quality_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_line_dedup", LINE_DEDUP)
def op9_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.size(F.split("text", "\n")).alias("n_lines_kept"), F.col("removed").alias("n_removed"), F.md5("text").alias("kept_md5")
    )


@query("op2_near_dedup", NEAR_DEDUP)
def op2_near_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).drop("tie")


@query("op10_vector_dedup", VECTOR_DEDUP)
def op10_vector_dedup(spark, sf):
    return link_vectors(table(spark, sf, "embeddings"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf):
    return repeated_spans(table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256")
    )


@query("op11_merkle_manifest", MERKLE)
def op11_merkle_manifest(spark, sf):
    proofs = prove(build_manifest(table(spark, sf, "documents")))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", hex_text(parent_digest(F.col("siblings"))).alias("proof_sha256"), "folded_root", "verified"
    )


@query("op13_hard_negatives", HARD_NEGATIVES)
def op13_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf, "embeddings"), label, F.col("vec_id") % 100 == 0)


@query("op12_license_scan", LICENSES)
def op12_license_scan(spark, sf):
    return scan_licenses(table(spark, sf, "documents")).drop("spans")
