"""Binary classification metrics as aggregations (per group when ``by`` is given)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from regionpulse.functions import ratio
from regionpulse.session import materialize


def threshold_scores(df: DataFrame, score: str = "score", threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    """PF20: prediction = 1 when score > threshold."""
    return df.withColumn(out, F.when(F.col(score) > threshold, 1).otherwise(0))


def cut_number(value, cuts, most: int):
    """How many of the sorted ``cuts`` (at most ``most``) lie below ``value``: a binary search
    as one expression, about log2(most) comparisons."""
    steps = [1 << k for k in reversed(range(max(1, most).bit_length()))]
    at = F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), at, lambda found, step: F.when(
        (found + step <= F.size(cuts)) & (F.get(cuts, found + step - 1) < value), found + step).otherwise(found))


def roc_auc(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), buckets: int = 256
) -> DataFrame:
    """ML9: exact ROC AUC by the rank-sum formula; tied scores get their average rank.

    Ranks need a running count over the sorted scores.  To keep that distributed,
    equal scores are first collapsed into one row (a hot score costs one row, written
    once), and each group's distinct scores are cut at approximate quantiles into
    ``buckets`` ranges of about equal row counts, however the scores are distributed.
    The running count is taken over bucket totals (<= buckets rows per group) and then
    inside each (group, bucket) window only.  Output: (by..., n_pos, n_neg, auc); auc is
    NULL when a class is missing.
    """
    by = list(by)
    s = df.select(*by, F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y"))
    s = s.filter(F.col("_s").isNotNull() & F.col("_y").isNotNull())
    ties = materialize(s.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_p")), "auc-ties")
    points = [k / buckets for k in range(1, buckets)]
    cuts = ties.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_s", points, 20 * buckets)).alias("_cuts"))
    if by:
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        held = ties.alias("l").join(cuts.alias("r"), same).select("l.*", "r._cuts")
    else:
        held = ties.withColumn("_cuts", cuts.select("_cuts").scalar())
    ties = held.select(*by, "_s", "_n", "_p", cut_number(F.col("_s"), F.col("_cuts"), buckets).alias("_b"))
    btot = ties.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"))
    bw = Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")  # <= buckets rows
    btot = btot.withColumn("_boff", F.coalesce(F.sum("_bn").over(bw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ties = ties.join(btot.select(*by, "_b", "_boff"), [*by, "_b"])
    inner = Window.partitionBy(*by, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_boff") + F.coalesce(F.sum("_n").over(inner), F.lit(0))
    ties = ties.withColumn("_avg_rank", below + (F.col("_n") + 1) / 2.0)
    agg = ties.groupBy(*by).agg(
        F.sum("_p").alias("n_pos"),
        (F.sum("_n") - F.sum("_p")).alias("n_neg"),
        F.sum(F.col("_p") * F.col("_avg_rank")).alias("_rank_sum"),
    )
    auc = ratio(F.col("_rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, F.col("n_pos") * F.col("n_neg"))
    return agg.select(*by, F.col("n_pos").cast("long"), F.col("n_neg").cast("long"), auc.alias("auc"))


def cv_auc(df: DataFrame, score: str = "score", label: str = "label", fold: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """ML4: cross-validated AUC per group: (by..., folds, cv_mean, cv_std2).

    One grouped AUC gives all folds; ``folds`` counts those with a defined AUC, ``cv_std2``
    is twice their population standard deviation."""
    by = list(by)
    per_fold = roc_auc(df, score, label, [*by, fold])
    return per_fold.groupBy(*by).agg(F.count("auc").alias("folds"), F.avg("auc").alias("cv_mean"), (2 * F.stddev_pop("auc")).alias("cv_std2"))


def f1_accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """ML10 + ML11: confusion counts, F1 of the positive class, accuracy."""
    by = list(by)
    p, y = F.col(prediction).cast("int"), F.col(label).cast("int")
    agg = df.groupBy(*by).agg(
        F.sum(F.when((p == 1) & (y == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((p == 1) & (y == 0), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((p == 0) & (y == 1), 1).otherwise(0)).alias("fn"),
        F.sum(F.when((p == 0) & (y == 0), 1).otherwise(0)).alias("tn"),
    )
    f1 = F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    acc = ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return agg.select(*by, "tp", "fp", "fn", "tn", f1.alias("f1"), acc.alias("accuracy"))
