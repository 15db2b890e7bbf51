"""Corpus pipeline: quality rules, near-duplicate removal, sanitisation of personal data,
mixing to target weights, and BPE encoding, each on all that the stage before it kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, all but the last with the columns of ``documents``.  ``run`` writes every
stage's result to the shared folder and reads it again as the next one's input.

Null texts, repeated rows and empty tables are each operator's defined cases; a table
without rows passes through all stages as a table without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpulse.llm import bpe_segment, host_rules, mixing, pii_sanitize, tensor_minhash
from regionpulse.llm.common import documents, vocabulary
from regionpulse.session import remove, scratch, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    return host_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return tensor_minhash.one_per_group(docs)


def sanitize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities generalised, disclosing terms removed; ``n_chars`` follows the text."""
    return pii_sanitize.sanitize(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out in the proportions of the target mixture."""
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    coded = bpe_segment.bpe_round_trip(docs.select("doc_id", "source", "text"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("sanitize", sanitize), ("mix", mix), ("encode", encode)]

#: BPE has no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``.  A stage's scratch tables are removed when its result is
    written, and that result when the next one is; the last stage is lazy, so its input stays."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
