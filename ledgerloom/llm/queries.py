"""The registered queries of this package and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    circulant_minhash, host_rules, language_mix, longest_match, packing, prefix_decontam, sentencepiece_codec, shallot_kmeans, toxicity_cnn,
    treap_search, url_asof, vertical_topk, warc_derivatives,
)
from ledgerloom.llm.statements import CLUSTER_SQL, DECONTAM_SQL, HOST_SQL, LEXICAL_SQL, NEAR_SQL, TOP_SQL, URL_SQL, WARC_SQL

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mix.language_mixture(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc_derivatives.derivatives(warc_derivatives.responses(table(spark, sf_dir, "pages")), ["page_id"])
    return made.drop("block").withColumn("headers_sha256", F.sha2("headers", 256)).drop("headers")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_match.token_counts(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_quality(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode, vocabulary, end = sentencepiece_codec.encoder()
    # The padding is the first number after the vocabulary.
    rows = packing.packed(table(spark, sf_dir, "documents"), encode, vocabulary, end, pad=vocabulary)
    return rows.select(
        "doc_ids", "offsets", "cu_seqlens", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_asof.judged(url_asof.captures_of(pages), url_asof.entries_of(pages))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "round_trip", "parity")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(treap_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical_topk.top_k(table(spark, sf_dir, "embeddings"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot_kmeans.clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_toxicity_cnn": op1,
    "op2_language_mixture": op2,
    "op3_warc_derivatives": op3,
    "op4_longest_match_tokens": op4,
    "op5_host_rules": op5,
    "op6_packed_ids": op6,
    "op7_circulant_minhash": op7,
    "op8_url_asof": op8,
    "op9_prefix_decontamination": op9,
    "op10_sentencepiece": op10,
    "op11_treap_search": op11,
    "op12_vertical_topk": op12,
    "op13_shallot_kmeans": op13,
}

ORACLES: dict[str, str] = {
    "op3_warc_derivatives": WARC_SQL,
    "op5_host_rules": HOST_SQL,
    "op7_circulant_minhash": NEAR_SQL,
    "op8_url_asof": URL_SQL,
    "op9_prefix_decontamination": DECONTAM_SQL,
    "op11_treap_search": LEXICAL_SQL,
    "op12_vertical_topk": TOP_SQL,
    "op13_shallot_kmeans": CLUSTER_SQL,
}
