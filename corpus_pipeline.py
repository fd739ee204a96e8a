"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; ``run`` writes each stage's
result to the shared folder as Parquet and reads it again as the next one's documents. All but the last return the columns
of ``documents``.

1. quality: documents that the quality classifier rejects go.
2. lines: lines of at least 20 characters that three or more documents hold stay only in the largest doc_id's.
3. near_duplicates: one document of each group of near copies stays, the smallest doc_id. SimHash near-dedup on five-word shingles, its links verified at a
   Jaccard similarity of 0.8; what 64 bits can't show at that similarity is found by minwise bands (``near_copies``).
4. decontaminate: documents that hold benchmark passages beyond the contamination rule go.
5. tokens: byte-level BPE ids, with digests of the ids and of the text that they decode to.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any name: further columns are
carried, repeated rows are treated alike, rows without an id are never dropped for another's sake, and an empty table stays empty.

The pipeline has no SQL: classifier, near copies and BPE cannot be expressed in it; tests compare each stage with plain Python.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sessionlake.llm import byte_bpe, decontaminate, line_dedup, near_copies, quality
from sessionlake.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts as good (score 0.5 or more); learned from ``labels`` of the documents at hand.

    A null text counts as empty and is judged by its statistics; without labelled rows all stay. Repeated rows get the same answer.
    """
    model = quality.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its repeated lines gone; n_chars follows the text, a null text stays null, as does an empty one.

    All rows without an id are one document, which never is the largest; rows that repeat an id are one document.
    """
    return line_dedup.replace_lines(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, with all rows that repeat it.

    Null and empty texts, and texts without words, are copies of each other. Rows without an id stay.
    """
    return near_copies.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated by ``benchmark`` (hit words are less than a twentieth of all, or none).

    Null and empty texts have no words and stay; null and empty items have no windows; repeated rows get the same answer.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of every row; null and empty texts have no ids. Repeated rows stay."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_digests(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("tokens", tokens_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
