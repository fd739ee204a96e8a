"""The registered queries opN_<name> of the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import (
    ann, byte_bpe, decontaminate, hard_negatives, language_id, license_scan, line_dedup, minhash, quality, secret_scan, simhash, url_filter, word_runs,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_contamination(docs, items))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(_table(spark, sf_dir, "documents")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(_table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.group_documents(_table(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group_documents(_table(spark, sf_dir, "documents"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digest(word_runs.find_runs(_table(spark, sf_dir, "documents"), rewrite=word_runs.repeat_tail))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.numbered(hard_negatives.corrupted(_table(spark, sf_dir, "embeddings")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_license_scan, op3_byte_bpe, op4_line_dedup, op5_language_id, op6_secret_scan, op7_simhash, op8_url_filter, op9_quality, op10_nearest,
        op11_minhash, op12_word_runs, op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_secret_scan": secret_scan.oracle(),
    "op8_url_filter": url_filter.ORACLE,
    "op11_minhash": minhash.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
