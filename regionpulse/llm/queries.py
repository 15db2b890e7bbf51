"""The registered queries of this subpackage: thin callers that derive the fixed result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpulse.llm import (
    backoff_lm,
    ball_tree,
    bpe_segment,
    frequency_trie,
    fst_tokens,
    host_rules,
    interleave,
    license_scan,
    merkle,
    mixing,
    pii_sanitize,
    tensor_minhash,
    two_fit,
)
from regionpulse.llm.common import documents, vocabulary
from regionpulse.llm.oracles import SQL


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(documents(spark, sf_dir))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_quality(documents(spark, sf_dir), keep_columns=["doc_id"])


def op3_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return fst_tokens.token_counts(docs, vocabulary("byte_bpe_50k.json"))


def op4_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.interleave(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op6_pii_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_sanitize.find(documents(spark, sf_dir))
    count = [F.size(F.array_remove(F.transform("spans", lambda s: s["kind_no"] == n), False)).cast("long").alias(f"n_{k}") for n, k in enumerate(pii_sanitize.KINDS)]
    return found.select("doc_id", *count, F.sha2(F.encode(pii_sanitize.written(F.col("spans")), "UTF-8"), 256).alias("base_sha256"),
                        pii_sanitize.written(F.col("all_spans")).alias("spans"))


def op7_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_duplicates(documents(spark, sf_dir))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe_segment.bpe_round_trip(docs, vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return two_fit.pack(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return ball_tree.search(documents(spark, sf_dir).select("doc_id", "text"), items)


def op13_frequency_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency_trie.variants(documents(spark, sf_dir).select("doc_id", "text"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_merkle_fingerprints, op2_host_quality, op3_fst_token_counts, op4_stratified_interleave, op5_license_scan, op6_pii_sanitize, op7_backoff_scores, op8_mix_sources, op9_tensor_minhash, op10_bpe_round_trip,
                                 op11_best_two_fit, op12_ball_tree_search, op13_frequency_trie)
}
