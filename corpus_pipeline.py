"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return
the columns of ``docs``; the last returns the token ids and the text that they stand
for.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, exact_dedup, piece_bpe, quality, simhash
from tablewright.llm.common import documents, stored

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It learns from the same labels as the registered query: those whose crc32 of the
    id, modulo 3, is not 1.
    """
    marks = quality.one_label_each(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    marks = marks.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    statistics = stored(quality.document_statistics(docs), "pipeline-statistics")
    return quality.keep_good(docs, quality.train(statistics, marks))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one_of_each(docs, words=5, similarity=0.8)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, its token ``ids`` with the end id, their number and the decoded text."""
    return piece_bpe.encode_texts(docs, PIECE_MODEL, decode=True).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded"
    )


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("encoding", encode_pieces),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
