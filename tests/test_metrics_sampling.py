"""Metrics against MLlib, sampling invariants, scaling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionpulse.operators import metrics as mt
from regionpulse.operators import sampling as sp


def test_auc_with_ties_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(0, 6)), int(rng.random() < 0.4)) for _ in range(500)]
    df = spark.createDataFrame(rows, "score DOUBLE, label INT")
    mine = mt.roc_auc(df, "score", "label").first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="lbl", metricName="areaUnderROC", numBins=0)
    ref = ev.evaluate(df.withColumn("lbl", F.col("label").cast("double")))
    assert mine == pytest.approx(ref, abs=1e-12)
    for b in (1, 3, 1024):
        assert mt.roc_auc(df, "score", "label", buckets=b).first()["auc"] == pytest.approx(ref, abs=1e-12)


def test_auc_separable_and_grouped(spark):
    df = spark.createDataFrame([(g, float(i), int(i >= 5)) for g in ("a", "b") for i in range(10)], "g STRING, score DOUBLE, label INT")
    out = {r["g"]: r["auc"] for r in mt.roc_auc(df, "score", "label", ["g"]).collect()}
    assert out == {"a": 1.0, "b": 1.0}


def test_f1_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "prediction INT, label INT")
    r = mt.f1_accuracy(df).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 1)
    assert r["f1"] == pytest.approx(4 / 6) and r["accuracy"] == pytest.approx(3 / 5)


def _frame(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = []
    for reg, npos in (("a", 7), ("b", 30)):
        for k in range(40):
            rows.append((base + dt.timedelta(hours=3 * k), reg, int(k < npos), float(k)))
    return spark.createDataFrame(rows, "t TIMESTAMP_NTZ, region STRING, label INT, x DOUBLE")


def test_undersample_balances_each_region(spark):
    s = sp.undersample(_frame(spark), seed=3)
    counts = {(r["region"], r["label"]): r["n"] for r in s.groupBy("region", "label").count().withColumnRenamed("count", "n").collect()}
    assert counts == {("a", 0): 7, ("a", 1): 7, ("b", 0): 10, ("b", 1): 10}
    s2 = sp.undersample(_frame(spark), seed=3)
    assert sorted(s.collect()) == sorted(s2.collect())  # reproducible


def test_split_and_folds_partition_rows(spark):
    s = sp.undersample(_frame(spark), seed=0)
    sp_ = sp.train_test_split(s, test_fraction=0.3, seed=0)
    n = {r["region"]: (r["n"], r["t"]) for r in sp_.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert n["a"] == (14, 5) and n["b"] == (20, 6)
    f = sp.cv_folds(s, 5).groupBy("region", "label", "fold").count().collect()
    assert sum(r["count"] for r in f) == s.count()
    sizes = sorted(r["count"] for r in f if r["region"] == "a" and r["label"] == 1)
    assert sizes == [1, 1, 1, 2, 2]


def test_standardize_population_std(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "region STRING, x DOUBLE")
    out = {(r["region"], r["x"]): r["x_z"] for r in sp.standardize(df, ["x"], suffix="_z").collect()}
    assert out[("a", 1.0)] == pytest.approx(-1.0) and out[("a", 3.0)] == pytest.approx(1.0)
    assert out[("b", 5.0)] == 0.0


def test_hash_draws_do_not_depend_on_session_time_zone(spark):
    utc = sorted(sp.undersample(_frame(spark), seed=5).select("t", "region").collect())
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = sorted(sp.undersample(_frame(spark), seed=5).select("t", "region").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc == ny


def test_quiet_intervals_drop_or_zero(spark):
    import datetime as dt

    from regionpulse.operators import labels as lab

    t1, t2 = dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 3)
    m = spark.createDataFrame([(t1, "a", 1.0), (t1, "b", 2.0), (t2, "a", 3.0)], "t TIMESTAMP_NTZ, region STRING, x DOUBLE")
    labels = spark.createDataFrame([(t1, "a", 1)], "t TIMESTAMP_NTZ, region STRING, label INT")
    drop = {(r["t"], r["region"]): r["label"] for r in lab.align_features_labels(m, labels).collect()}
    zero = {(r["t"], r["region"]): r["label"] for r in lab.align_features_labels(m, labels, "zero").collect()}
    assert drop == {(t1, "a"): 1, (t1, "b"): 0}
    assert zero == {(t1, "a"): 1, (t1, "b"): 0, (t2, "a"): 0}
    pct = {r["region"]: (r["positives"], r["percent"]) for r in lab.percent_labeled(lab.align_features_labels(m, labels), labels).collect()}
    assert pct == {"a": (1, 100)}


def test_auc_buckets_stay_even_on_skewed_scores(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from regionpulse.operators import metrics as mt

    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(0, 4, 20_000))
    y = (rng.random(20_000) < 1 / (1 + np.exp(-np.log(x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score DOUBLE, label INT")
    points = [k / 256 for k in range(1, 256)]
    cuts = df.agg(F.array_distinct(F.percentile_approx("score", points, 5120)).alias("c"))
    sizes = [r["n"] for r in df.crossJoin(cuts).groupBy(mt.cut_number(F.col("score"), F.col("c"), 256).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 200 and max(sizes) < 4 * 20_000 / 256
    order = np.argsort(x)
    rank = np.empty(20_000)
    rank[order] = np.arange(1, 20_001)
    p, n = y.sum(), (1 - y).sum()
    assert abs(mt.roc_auc(df).first()["auc"] - (rank[y == 1].sum() - p * (p + 1) / 2) / (p * n)) < 1e-9
