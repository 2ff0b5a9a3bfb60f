"""From raw documents to training pieces: five stages, each writing a table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstborn.llm.common import DOCUMENTS, SPACES, table
from firstborn.llm.line_dedup import dedup_lines
from firstborn.llm.mixing import mixed_documents
from firstborn.llm.near_dedup import keep_first_of_group
from firstborn.llm.piece_codec import encode_pieces
from firstborn.llm.quality import fit_quality, keep_quality
from firstborn.session import scratch_path

QUALITY_KEPT = 0.3
#: Similarity of 0.8 or more, as for lines.
NEAR = (4, 5)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least QUALITY_KEPT; null texts score as empty ones."""
    docs = docs.select(*DOCUMENTS)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return keep_quality(docs, model, QUALITY_KEPT, DOCUMENTS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; one left without a word goes, one without words before stays."""
    lines = dedup_lines(docs.select(*DOCUMENTS))
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == ""
    size = F.when(F.col("removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return lines.filter(~(blank & (F.col("removed") > 0))).withColumn("n_chars", size).select(*DOCUMENTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity NEAR): the least doc_id."""
    return keep_first_of_group(docs.select(*DOCUMENTS), NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: sources weigh 5, 2, 1 in turn, share 150 % of all words, none above twice its size."""
    return mixed_documents(docs.select(*DOCUMENTS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_pieces of every row's text."""
    encoded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.withColumn("n_pieces", F.size("ids").cast("bigint"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the trained classifier; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
