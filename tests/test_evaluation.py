"""Fits trained together against one fit at a time: Newton steps, landmark SVM, forests, whole evaluations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from regionpulse.config import FEATURES, PipelineConfig
from regionpulse.operators import batched as bt
from regionpulse.operators import forest as fo
from regionpulse.operators import landmarks as lm
from regionpulse.operators import metrics as mt
from regionpulse.operators import sampling as sp
from regionpulse.plans import evaluate as ev


def make_frame(spark, regions=("a", "b", None), per=120, seed=0):
    rng = np.random.default_rng(seed)
    base, rows = dt.datetime(2024, 1, 1), []
    for g, region in enumerate(regions):
        for k in range(per):
            x = rng.normal(size=5) * (1 + 20 * g) + g
            y = int(x[0] + 0.7 * x[1] + rng.normal() * (1 + 20 * g) > 0.4)
            rows.append((base + dt.timedelta(hours=3 * k), region or "few", y, *map(float, np.round(x, 1)), *map(float, x)))
    few = [r for r in rows if r[1] == "few"]
    rows = [r for r in rows if r[1] != "few"] + few[:3]
    cols = ", ".join([f"s_{f} DOUBLE" for f in FEATURES] + [f"d_{f} DOUBLE" for f in FEATURES])
    return spark.createDataFrame(rows, f"t TIMESTAMP_NTZ, region STRING, label INT, {cols}")


@pytest.fixture(scope="module")
def rows(spark):
    sample = ev.sample_runs(make_frame(spark, ("a", "b")), PipelineConfig(), [0])
    out = bt.fit_rows(sample, 5)
    return spark.createDataFrame(out.collect(), out.schema).cache()


def one_fit(rows, **key):
    df = rows
    for k, v in {"run": 0, "scaled": True, "fold": bt.TEST_FOLD, "feature_set": "sparse", "region": "a", **key}.items():
        df = df.filter(F.col(k) == v)
    return df


def test_solve(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(6, 6))
    m, b = m @ m.T + np.eye(6), rng.normal(size=6)
    df = spark.createDataFrame([([[*map(float, r), float(v)] for r, v in zip(m, b)],)], "m ARRAY<ARRAY<DOUBLE>>")
    assert np.allclose(df.select(bt.solve(F.col("m"), 6)).first()[0], np.linalg.solve(m, b))


def test_fit_rows_scale_on_training_rows(spark, rows):
    sample = ev.sample_runs(make_frame(spark, ("a", "b")), PipelineConfig(), [0]).withColumn("k", F.lit(1))
    want = sp.standardize(sample.filter("region = 'b'"), ["d_obs_freq"], fit_mask=F.col("fold") != 2, suffix="_z")
    got = one_fit(rows, region="b", fold=2, feature_set="dynamic")
    assert np.allclose(sorted(r[0] for r in got.select("x1").collect()), sorted(r[0] for r in want.select("d_obs_freq_z").collect()))
    held = {r["held_out"]: r["count"] for r in got.groupBy("held_out").count().collect()}
    assert held[True] == want.filter("fold = 2").count() and held[False] == want.filter("fold <> 2").count()


def test_logistic_equals_mllib(rows):
    train = rows.filter("not held_out")
    betas = {tuple(r[k] for k in bt.KEYS): r for r in bt.logistic(train).collect()}
    assert len(betas) == 2 * 2 * 2 * 6 and not any(r["moved"] for r in betas.values())
    for key in ({"scaled": False}, {"region": "b", "scaled": False, "feature_set": "dynamic"}, {"fold": 3}):
        mine = one_fit(train, **key)
        fitted = LogisticRegression(regParam=1.0 / mine.count(), standardization=False, maxIter=500, tol=1e-13).fit(
            VectorAssembler(inputCols=list(bt.X), outputCol="features").transform(mine))
        first = mine.first()
        got = betas[tuple(first[k] for k in bt.KEYS)]["beta"]
        assert np.allclose(got, [fitted.intercept, *fitted.coefficients], atol=1e-6)


def test_logistic_of_separable_and_one_class_fits(spark):
    data = [(g, float(x), int(x > 0) if g else 1) for g in (0, 1) for x in (-300, -2, 1, 500)]
    df = spark.createDataFrame(data, "g INT, x DOUBLE, label INT")
    got = {r["g"]: r["beta"] for r in bt.logistic(df, ["g"], ["x"], iterations=12).collect()}
    assert np.isfinite(got[0]).all() and np.isfinite(got[1]).all() and got[1][1] > 0
    held = df.withColumn("k", F.lit(0))
    scored = bt.logistic_scores(held, spark.createDataFrame([(g, b) for g, b in got.items()], "g INT, beta ARRAY<DOUBLE>"), ["g"], ["x"])
    assert all(r["prediction"] == r["label"] for r in scored.collect())
    assert bt.logistic(df.limit(0), ["g"], ["x"]).collect() == []


def exact_svm(x, y, gamma, cost=1.0, passes=3000):
    k = lm.kernel(x, x, gamma) + 1.0
    s = np.where(y > 0.5, 1.0, -1.0)
    a, f = np.zeros(len(s)), np.zeros(len(s))
    for _ in range(passes):
        for i in range(len(s)):
            new = min(max(a[i] + (1 - s[i] * f[i]) / k[i, i], 0), cost)
            f += (new - a[i]) * s[i] * k[i]
            a[i] = new
    return a * s


def numbers(df):
    got = np.array([[r[c] for c in (*bt.X, "label")] for r in df.collect()], dtype=float)
    return got[:, :-1], got[:, -1]


@pytest.mark.parametrize("block_rows, landmarks, bound", [(4096, 500, 0.02), (30, 500, 0.35), (4096, 60, 0.3)])
def test_landmark_svm_near_exact_kernel(rows, block_rows, landmarks, bound):
    """All rows as landmarks: the exact machine up to convergence, three blocks are still on their way after 15 passes; 60 of 84 landmarks: within 0.3 on average."""
    fits = rows.filter("run = 0 and fold = -1 and feature_set = 'sparse' and scaled")
    model = lm.fit(fits.filter("not held_out"), landmarks=landmarks, block_rows=block_rows, passes=15 if block_rows < 100 else 4, epochs=60)
    got = lm.scores(fits.filter("held_out"), model)
    x, y = numbers(one_fit(fits.filter("not held_out")))
    xt, yt = numbers(one_fit(fits.filter("held_out")))
    want = (lm.kernel(xt, x, 0.2) + 1.0) @ exact_svm(x, y, 0.2)
    mine = sorted((r["label"], r["score"]) for r in one_fit(got, ).collect())
    miss = np.abs(np.array([s for _, s in mine]) - np.array([s for _, s in sorted(zip(yt, want))]))
    assert (miss.mean() if landmarks < 100 else miss.max()) < bound
    assert {r["region"] for r in model.collect()} == {"a", "b"}


def test_blocks_spread_equal_rows(spark):
    df = spark.createDataFrame([("f", 1, 0.0)] * 300 + [("f", 0, float(k)) for k in range(100)], "g STRING, label INT, x DOUBLE")
    got = bt.blocks(df, ["g"], ["x"], 50).collect()
    assert len(got) == 8 and sum(len(r["label"]) for r in got) == 400 and max(len(r["label"]) for r in got) < 80
    assert sorted(v for r in got for v in r["x"]) == sorted([0.0] * 301 + [float(k) for k in range(1, 100)])
    some = bt.blocks(df, ["g"], ["x"], 1 << 40, most_rows=40).collect()
    assert len(some) == 1 and 20 < len(some[0]["x"]) < 60 and some[0]["n"] == 400


def test_forest(spark, rows):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (200, 4)).astype(float)
    y = (x[:, 1] > 2).astype(float)
    tree = fo.grow(x, y, rng, 4, 30)
    assert (fo.shares(tree, x) == y).all() and len(tree[0]) == 3
    assert len(fo.grow(x, rng.integers(0, 2, 200).astype(float), rng, 2, 1)[0]) <= 3
    assert fo.grow(x[:0].reshape(0, 4)[:0], np.ones(1), rng, 2, 5)[0].tolist() == [-1]
    fits = rows.filter("fold = -1 and scaled")
    model = fo.fit(fits.filter("not held_out"), trees=60, trees_per_task=25, tasks=4)
    assert model.count() == 2 * 2 * 3
    auc = {(r["region"], r["feature_set"]): r["auc"] for r in mt.roc_auc(fo.scores(fits.filter("held_out"), model, tasks=4), by=["region", "feature_set"]).collect()}
    assert len(auc) == 4 and min(auc.values()) > 0.6


def test_all_regions_in_one_call(spark):
    frame = make_frame(spark)
    config = PipelineConfig(landmarks=40, forest_depth=6)
    both = {(r["region"], r["model"], r["feature_set"], r["scaled"], r["seed"]): r for r in ev.evaluate_regions(frame, config, ["lr", "svm", "rf"], seeds=[0, 1]).collect()}
    assert len(both) == 2 * 3 * 2 * 2 * 2 and {k[0] for k in both} == {"a", "b"}  # the region of few rows is left out
    alone = ev.evaluate_region(frame, "b", config, ["lr"]).collect()
    assert len(alone) == 4
    for r in alone:
        other = both[r["region"], "lr", r["feature_set"], r["scaled"], 0]
        assert r["cv_folds"] == 5 and all(r[c] == pytest.approx(other[c], abs=1e-9) for c in ("cv_mean", "cv_std", "auc", "f1", "accuracy"))
    assert min(r["auc"] for k, r in both.items() if k[1] == "lr") > 0.7 and min(r["auc"] for k, r in both.items() if k[3]) > 0.55
    mean = ev.repeat_evaluation(frame, "b", 2, config, ["lr"]).collect()
    for r in mean:
        assert r["runs"] == 2 and r["auc"] == pytest.approx(np.mean([both["b", "lr", r["feature_set"], r["scaled"], s]["auc"] for s in (0, 1)]))


def test_pooled_evaluation_and_network(spark):
    frame = make_frame(spark, ("a", "b"), 60)
    got = ev.evaluate_region(frame, None, PipelineConfig(folds=2, train_partitions=1, network_iterations=30), ["lr", "mlp"]).collect()
    assert {(r["region"], r["model"], r["scaled"]) for r in got} == {("(all)", "lr", False), ("(all)", "lr", True), ("(all)", "mlp", True)}
    assert all(r["cv_folds"] == 2 and r["auc"] > 0.5 for r in got)


def test_one_class_has_null_metrics(spark):
    """A table in which every interval has an incident, and a network asked of regions with too few rows."""
    frame = make_frame(spark, ("a", "b"), 20).withColumn("label", F.lit(1))
    for region in (None, "a"):
        got = ev.evaluate_region(frame, region, PipelineConfig())
        rows = got.collect()
        assert {(r["model"], r["feature_set"], r["scaled"]) for r in rows} == {(m, s, z) for m in ("svm", "lr", "rf", "mlp") for s in ("sparse", "dynamic") for z in (False, True) if z or m != "mlp"}
        assert len(rows) == 14 and all(r["region"] == (region or "(all)") and r["cv_folds"] == 0 and r["auc"] is None and r["f1"] is None and r["cv_mean"] is None for r in rows)
    report = ev.comparison_report(got).collect()
    assert len(report) == 7 and all(r["delta_auc"] is None for r in report)
    mean = ev.repeat_evaluation(frame, "a", 3, PipelineConfig(), ["lr"]).collect()
    assert len(mean) == 4 and all(r["runs"] == 3 and r["cv_folds"] == 0 and r["auc"] is None for r in mean)
    assert ev.evaluate_regions(frame, PipelineConfig(), ["mlp"]).collect() == []
    with pytest.raises(ValueError, match="no rows"):
        ev.evaluate_region(frame, "nowhere", PipelineConfig(), ["lr"])


def test_remembered_build(spark, monkeypatch):
    """Two threads share one build; a build whose tables are gone is made again."""
    import time
    from concurrent.futures import ThreadPoolExecutor
    from types import SimpleNamespace

    from regionpulse.plans import queries
    from regionpulse.session import materialize, remove

    made = []

    def build(*_):
        made.append(1)
        time.sleep(2)
        return SimpleNamespace(frame=materialize(spark.range(4), "built"))

    monkeypatch.setattr(queries, "_BUILT", {})
    monkeypatch.setattr(queries.pl, "build", build)
    of = lambda _: queries._dynamic(spark, "/root/testdata/sf0.001")
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(of, range(2))
    assert one is two and len(made) == 1
    remove(spark, one.frame.inputFiles())
    again = of(0)
    assert len(made) == 2 and again.frame.count() == 4 and of(0) is again


def test_report_holds_every_region(spark, monkeypatch):
    """The report of the whole table: each region has its seven rows, one of few rows with null metrics."""
    from types import SimpleNamespace

    from regionpulse.plans import queries

    frame = make_frame(spark, per=60)
    config = PipelineConfig(landmarks=40, forest_depth=4, folds=2, train_partitions=1, network_iterations=5)
    monkeypatch.setattr(queries, "_dynamic", lambda *_: SimpleNamespace(frame=frame))
    monkeypatch.setattr(queries, "FIXTURE_CONFIG", config)
    report = {(r["region"], r["model"], r["scaled"]): r for r in queries.REGISTRY["comparison_report"](spark, "unused").collect()}
    assert len(report) == 3 * 7 and {k[0] for k in report} == {"a", "b", "few"}
    assert all((r["delta_auc"] is None) == (k[0] == "few") for k, r in report.items())
    alone = ev.comparison_report(ev.evaluate_region(frame, "b", config, ["lr"])).collect()
    assert alone and all(report["b", "lr", r["scaled"]]["delta_auc"] == pytest.approx(r["delta_auc"], abs=1e-9) for r in alone)


def test_grown_splits_are_the_best():
    """Every node of a tree that tries all features splits at the best Gini gain there is, in bootstraps too."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3)).round(1)
    x[:, 2] = 4.0  # constant
    y = (x[:, 0] + rng.normal(size=150) > 0).astype(float)
    trees = fo.bootstrap_trees(x, y, range(4), 3, 3, 30, most_pairs=300)
    assert [t.tolist() for one in fo.bootstrap_trees(x, y, range(4), 3, 3, 30) for t in one] == [t.tolist() for one in trees for t in one]
    for number, (feature, threshold, left, right, share) in enumerate(trees):
        drawn = np.random.default_rng([3, number]).integers(0, 150, 150)
        rows = {0: drawn}
        gain = lambda low, high: sum(y[s].sum() ** 2 / len(s) + (1 - y[s]).sum() ** 2 / len(s) for s in (low, high))
        for node in range(len(feature)):
            s = rows[node]
            assert share[node] == y[s].mean()
            cuts = [gain(s[x[s, f] <= v], s[x[s, f] > v]) for f in range(3) for v in np.unique(x[s, f])[:-1]]
            if feature[node] < 0:
                assert share[node] in (0, 1) or not cuts
                continue
            low = x[s, feature[node]] <= threshold[node]
            rows[left[node]], rows[right[node]] = s[low], s[~low]
            assert gain(s[low], s[~low]) == pytest.approx(max(cuts))
        assert len(rows) == len(feature)


def test_forest_of_more_rows_than_a_sample(spark):
    """100,000 training rows, a thousand of them rare: all are known to the forest, a sample of 50,000 misses half."""
    rng = np.random.default_rng(6)
    rare = spark.createDataFrame([("a", float(k), int(v)) for k, v in enumerate(rng.integers(0, 2, 1000))], "g STRING, x DOUBLE, label INT")
    train = rare.union(spark.range(99_000).selectExpr("'a'", "-1.0D", "0"))
    model = fo.fit(train, ["g"], ["x"], trees=50, tasks=4)
    got = fo.scores(rare, model, ["g"], ["x"], tasks=4).groupBy().agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("right")).first()["right"]
    assert got > 0.95


def test_forest_in_blocks_equals_one_array(spark):
    """Blocks over many Arrow batches, two fits a task: trees and scores are those of the plain arrays."""
    rng = np.random.default_rng(7)
    data = [(g, *map(float, rng.normal(size=2)), int(rng.integers(0, 2))) for g in ("a", "b") for _ in range(200)]
    df = spark.createDataFrame(data, "g STRING, p DOUBLE, q DOUBLE, label INT")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        model = fo.fit(df, ["g"], ["p", "q"], trees=6, trees_per_task=2, block_rows=30, tasks=1).collect()
        got = fo.scores(df, spark.createDataFrame(model), ["g"], ["p", "q"], block_rows=30, tasks=1).collect()
        dealt = bt.blocks(df, ["g"], ["p", "q"], 30).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(model) == 2 * 3 and len(got) == 400
    for g in ("a", "b"):
        mine = sorted((r for r in dealt if r["g"] == g), key=lambda r: r["block"])
        x, y = np.concatenate([r["x"] for r in mine]).reshape(-1, 2), np.concatenate([r["label"] for r in mine])
        want = fo.bootstrap_trees(x, y, range(6), 0, 1, 30)
        held = [t for r in sorted((r for r in model if r["g"] == g), key=lambda r: r["part"]) for t in fo.unpack(r["grown"])]
        assert len(mine) > 3 and all((a[0] == b[0]).all() and (fo.shares(a, x) == fo.shares(b, x)).all() for a, b in zip(held, want, strict=True))
        scores = sorted((r["label"], r["score"]) for r in got if r["g"] == g)
        assert np.allclose(scores, sorted(zip(y, sum(fo.shares(t, x) for t in want) / 6)))


def test_region_trains_on_all_rows(spark, monkeypatch):
    """Forest and kernel machine of one region deal out every training row, none asks for a sample."""
    seen = []

    def watched(rows, by, columns, *args, **kw):
        packed = bt.blocks(rows, by, columns, *args, **kw)
        asked = dict(zip(("block_rows", "most_rows", "seed"), args), **kw).get("most_rows")
        seen.append((asked, rows.count(), packed.agg(F.sum(F.size("label"))).first()[0]))
        return packed

    monkeypatch.setattr(fo, "blocks", watched)
    monkeypatch.setattr(lm, "blocks", watched)
    config = PipelineConfig(landmarks=20, forest_depth=4, folds=2)
    assert len(ev.evaluate_region(make_frame(spark, ("a", "b"), 60), "a", config, ["svm", "rf"]).collect()) == 8
    assert len(seen) == 4 and all(asked is None and n == dealt > 0 for asked, n, dealt in seen)


def test_large_rows_in_small_groups(spark):
    """Rows of megabytes: a reading task takes a few of them at once, not a whole file."""
    import pyarrow.parquet as pq

    from regionpulse.session import materialize

    wide = spark.range(0, 30, 1, 1).select("id", F.expr("transform(sequence(1, 200000), k -> sin(k * (id + 1)))").alias("x"))
    table = materialize(wide, "wide", large_rows=True)
    assert table.count() == 30
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
    assert sum(m.num_rows for m in groups) == 30 and max(m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)) < 20
