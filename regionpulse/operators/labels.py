"""Incident labels per (t, region) and their alignment with the feature matrix.

Labels are kept sparse: only observed (t, region) pairs are stored; a missing pair
is label 0.  This replaces the wide label matrix (intervals x regions) with no loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpulse.functions import ratio, time_bin


def incident_counts(incidents: DataFrame, interval: str = "3 hours", ts_col: str = "ts") -> DataFrame:
    """AG10: incidents per observed (t, region)."""
    b = incidents.withColumn("t", time_bin(ts_col, interval))
    b = b.filter(F.col("t").isNotNull() & F.col("region").isNotNull())
    return b.groupBy("t", "region").agg(F.count(F.lit(1)).alias("n_incidents"))


def binary_labels(counts: DataFrame, count_col: str = "n_incidents") -> DataFrame:
    """PF14: label = min(count, 1) as int."""
    return counts.select("t", "region", F.least(F.col(count_col), F.lit(1)).cast("int").alias("label"))


def label_intervals(labels: DataFrame) -> DataFrame:
    """Intervals with at least one incident anywhere (rows of the wide label matrix)."""
    return labels.select("t").distinct()


def align_features_labels(matrix: DataFrame, labels: DataFrame, quiet_intervals: str = "drop") -> DataFrame:
    """JN8 / ST3: keep the feature rows whose interval has labels, attach label (0 if absent).

    ``quiet_intervals='drop'`` reproduces the reference (intervals without any incident
    vanish); ``'zero'`` keeps them with label 0.
    """
    m = matrix
    if quiet_intervals == "drop":
        m = m.join(label_intervals(labels), "t", "left_semi")
    pos = labels.filter(F.col("label") > 0).select("t", "region", "label")
    return m.join(pos, ["t", "region"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def percent_labeled(aligned_intervals: DataFrame, labels: DataFrame) -> DataFrame:
    """AG12: per label region, share of the kept intervals with label 1.

    ``percent`` truncates like ``int()``, ``percent_exact`` keeps the fraction.
    """
    kept = aligned_intervals.select("t").distinct()
    n = kept.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    regions = labels.select("region").distinct()
    pos = (
        labels.filter(F.col("label") > 0).join(kept, "t", "left_semi")
        .groupBy("region").agg(F.count(F.lit(1)).alias("positives"))
    )
    out = regions.join(pos, "region", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))
    exact = ratio(F.col("positives") * 100, n)
    return out.select("region", "positives", F.floor(exact).cast("int").alias("percent"), exact.alias("percent_exact"))


def class_frequency(aligned: DataFrame, label_col: str = "label", by: str = "region") -> DataFrame:
    """AG13: rows per (region, label)."""
    return aligned.groupBy(by, label_col).agg(F.count(F.lit(1)).alias("n"))
