"""Proportional stratified interleaving into shards (DataFrame operations only).

Rows of each source are put in a seeded random order; row r of n has the fractional rank
(2r - 1) / 2n.  Sorted by fractional rank, every stretch of the corpus has each source in
its corpus proportion, so cutting that order into equal runs gives shards that match the
mixture, with row counts at most one apart.

Both rankings are made without a global or a per-source sort: values are cut into about
sqrt(N) equal buckets (the ranking hash is uniform, and so are fractional ranks), bucket
counts are summed up, and rows are numbered inside their bucket.  A source with a third
of all rows is spread over all buckets.

Defined cases: a null text has no bytes and crc32 0; a null source is a stratum of its
own; rows equal in id, text and source are interchangeable; an empty table gives an empty
result.  Only the id, the text and the source are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regionpulse.llm.common import materialize, order_key, source_key, text_or_empty

SEED = "interleave-1"


def numbered(df: DataFrame, bucket: str, order: list, by: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the 0-based place of each row in the order of ``bucket``, then
    ``order``, within the groups ``by``.  Counts per bucket are the only thing summed along
    a whole group."""
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    counts = df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(group.orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    inside = df.withColumn("_at", F.row_number().over(W.partitionBy(*by, bucket).orderBy(*order)))
    return inside.join(before, [*by, bucket]).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_before", "_at")


def interleave(docs: DataFrame, n_shards: int = 8, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, source_key, shard, slot) of every row; ``slot`` counts from
    0 without gaps in each shard."""
    t = text_or_empty(text)
    crc = F.crc32(F.encode(t, "UTF-8")).cast("long")
    rows = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), crc.alias("text_crc32"),
        source_key(source).alias("source_key"), order_key(seed, F.col(doc_id), crc).alias("_key")), "interleave-rows")
    per_source = rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("_of"))
    total = rows.count()
    buckets = max(1, math.isqrt(total))
    ties = ["_key", "doc_id", "text_crc32", "size"]
    ranked = numbered(rows.withColumn("_b", F.floor(F.col("_key") / F.lit(float(1 << 60)) * buckets)), "_b", ties, ["source_key"], "_r")
    spread = (ranked.drop("_b").join(per_source, "source_key")
              .withColumn("_f", (2 * F.col("_r") + 1) / (2 * F.col("_of")))
              .withColumn("_b", F.floor(F.col("_f") * buckets)))
    placed = numbered(spread, "_b", ["_f", "source_key", *ties], [], "_place")
    shard = F.expr(f"(_place * {n_shards}) div {max(1, total)}").cast("int")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", (F.col("_place") - first).cast("long"))
            .select("doc_id", "size", "text_crc32", "source_key", "shard", "slot"))
