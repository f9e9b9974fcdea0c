"""The corpus pipeline: documents in, encoded documents out, each stage a written table.

Quality rules and language identification drop what they reject, near-duplicate detection keeps one
document of each group, decontamination drops documents with a benchmark window, and the rest is encoded.

Defined cases: null and empty texts and texts of fewer than 20 words fail the quality rules; a null id, host or
language is a value like others, and each row is judged by its own text; of repeated rows one stays (near
duplicates); texts of any length are worked on whole; columns beyond those of documents go along up to the last
stage, whatever their names; an empty table gives no row, and where no language is learned none is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import circulant_minhash, host_rules, language_mix, prefix_decontam, sentencepiece_codec
from ledgerloom.scale import materialized

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_mix.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return circulant_minhash.keep_one_of_each(docs, circulant_minhash.AT_80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefix_decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

# Language proportions and token ids are no SQL; tests/llm checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
