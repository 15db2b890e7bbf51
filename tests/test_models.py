"""Classifier wrappers and the evaluation driver on small toy tables."""

import datetime as dt

import numpy as np
import pytest

from regionpulse.config import FEATURES, PipelineConfig
from regionpulse.operators import metrics as mt
from regionpulse.operators import models as md
from regionpulse.plans import evaluate as ev


def _xy(spark, X, y):
    rows = [tuple(float(v) for v in x) + (int(l),) for x, l in zip(X, y)]
    return spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, label INT")


def test_separable_data_gives_auc_one(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 2))
    y = (X[:, 0] > 0).astype(int)
    X[:, 0] += np.where(y == 1, 1.0, -1.0)
    df = _xy(spark, X, y)
    s = md.fit_score(df, df, ["a", "b"], "lr")
    assert mt.roc_auc(s).first()["auc"] == pytest.approx(1.0)


def test_rbf_features_beat_linear_on_ring(spark):
    rng = np.random.default_rng(1)
    r = np.concatenate([rng.uniform(0, 1, 200), rng.uniform(2, 3, 200)])
    a = rng.uniform(0, 2 * np.pi, 400)
    X = np.c_[r * np.cos(a), r * np.sin(a)]
    y = (r < 1.5).astype(int)  # inner disc 1, outer ring 0
    idx = rng.permutation(400)
    tr, te = _xy(spark, X[idx[:280]], y[idx[:280]]), _xy(spark, X[idx[280:]], y[idx[280:]])
    auc_lr = mt.roc_auc(md.fit_score(tr, te, ["a", "b"], "lr")).first()["auc"]
    auc_svm = mt.roc_auc(md.fit_score(tr, te, ["a", "b"], "svm")).first()["auc"]
    assert auc_svm > 0.95 and auc_svm > auc_lr + 0.2


def test_evaluation_refuses_too_few_rows(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=3 * k), "a", int(k < 2)) + tuple(float(k) for _ in range(10)) for k in range(20)]
    cols = ", ".join([f"s_{f} DOUBLE" for f in FEATURES] + [f"d_{f} DOUBLE" for f in FEATURES])
    frame = spark.createDataFrame(rows, f"t TIMESTAMP_NTZ, region STRING, label INT, {cols}")
    with pytest.raises(ValueError):
        ev.evaluate_region(frame, "a", PipelineConfig(), ["lr"])


def test_comparison_report_delta(spark):
    res = spark.createDataFrame(
        [("x", "lr", "sparse", False, 0, 5, 0.5, 0.1, 0.6, 0.5, 0.55), ("x", "lr", "dynamic", False, 0, 5, 0.55, 0.1, 0.62, 0.5, 0.6)],
        ev.RESULT_SCHEMA)
    r = ev.comparison_report(res).first()
    assert r["delta_cv_mean"] == pytest.approx(0.05) and r["delta_auc"] == pytest.approx(0.02)
