"""Dense-vs-sparse feature evaluation (the reference's per-region experiment).

For one region (or all regions pooled): balance classes, split 70/30 with one seed
for both feature sets, optionally standardise, then for each model report the test
AUC / F1 / accuracy and the 5-fold CV AUC (mean and 2 x population std).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpulse.config import FEATURES, PipelineConfig
from regionpulse.operators import batched as bt
from regionpulse.operators import forest as fo
from regionpulse.operators import landmarks as lm
from regionpulse.operators import metrics as mt
from regionpulse.operators import models as md
from regionpulse.operators import sampling as sp
from regionpulse.session import materialize, scratch

RESULT_SCHEMA = ("region STRING, model STRING, feature_set STRING, scaled BOOLEAN, seed INT, "
                 "cv_folds INT, cv_mean DOUBLE, cv_std DOUBLE, auc DOUBLE, f1 DOUBLE, accuracy DOUBLE")


def evaluation_frame(sparse: DataFrame, dense: DataFrame, labels_aligned: DataFrame | None = None) -> DataFrame:
    """(t, region, label, s_<f>..., d_<f>...) rows: sparse and dense features side by side."""
    base = labels_aligned if labels_aligned is not None else sparse
    s = base.select("t", "region", "label", *[F.col(f).cast("double").alias(f"s_{f}") for f in FEATURES])
    d = dense.select("t", "region", *[F.col(f).cast("double").alias(f"d_{f}") for f in FEATURES])
    return s.join(d, ["t", "region"])


def sample_runs(frame: DataFrame, config: PipelineConfig, seeds: Sequence[int]) -> DataFrame:
    """ML1, ML2, ML4 for each seed: balanced rows with ``run``, ``is_test`` and ``fold``."""
    runs = []
    for seed in seeds:
        s = sp.undersample(frame, by=("region",), seed=seed)
        s = sp.train_test_split(s, by=("region",), test_fraction=config.test_fraction, seed=seed)
        runs.append(sp.cv_folds(s, config.folds, by=("region",)).withColumn("run", F.lit(seed)))
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out


def _network_scores(train: DataFrame, held: DataFrame, config: PipelineConfig, parallelism: int) -> DataFrame:
    """ML8: one MLlib network per fit, as concurrent jobs from ``parallelism`` driver threads."""
    from concurrent.futures import ThreadPoolExecutor
    from functools import reduce

    fits = train.select(*bt.KEYS).distinct().collect()  # keys of fits, a few per region
    if not fits:  # no region has enough rows of both classes
        return held.limit(0).select(*bt.KEYS, "label", F.lit(0.0).alias("score"), F.lit(0).alias("prediction"))

    def run(key):
        mine = reduce(lambda a, b: a & b, [F.col(k) == key[k] for k in bt.KEYS])
        scored = md.fit_score(train.filter(mine), held.filter(mine), bt.X, "mlp", int(key["run"]), keep=bt.KEYS, partitions=config.train_partitions,
                              iterations=config.network_iterations, threshold=config.score_threshold)
        return scored.select(*bt.KEYS, "label", "score", "prediction")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return reduce(lambda a, b: a.union(b), pool.map(run, fits))


def evaluate_regions(
    frame: DataFrame,
    config: PipelineConfig = PipelineConfig(),
    models: Sequence[str] = md.MODELS,
    leaky_scaling: bool = False,
    min_per_class: int = 5,
    seeds: Sequence[int] | None = None,
    pooled: str | None = None,
    parallelism: int = 8,
) -> DataFrame:
    """ML12 for every region of ``frame`` and every seed in one call: a row per (region, model,
    feature_set, scaled, seed); the neural model runs scaled only.

    All fits of a model train together (``operators.batched``), all scored rows go into one
    table, and one grouped AUC and one grouped F1 give all metrics.  Regions with fewer than
    ``min_per_class`` balanced rows of a class are left out.  ``pooled`` names one region that
    stands for all (classes balanced and features scaled per region)."""
    spark = frame.sparkSession
    with scratch(spark):
        drawn = materialize(sample_runs(frame, config, [config.seed] if seeds is None else seeds), "eval-sample")
        group = ["run"] if pooled else ["run", "region"]
        sizes = drawn.groupBy(*group).agg(F.sum(F.col("label")).alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
        able = drawn.join(sizes.filter(F.least("pos", "neg") >= min_per_class).select(*group), group)
        rows = materialize(bt.fit_rows(able, config.folds, leaky=leaky_scaling, pooled=pooled), "eval-rows")
        train, held = rows.filter("not held_out"), rows.filter("held_out")
        scored = []
        for model in models:
            if model == "lr":
                one = bt.logistic_scores(held, bt.logistic(train))
            elif model == "svm":
                one = lm.scores(held, lm.fit(train, landmarks=config.landmarks, seed=config.seed))
            elif model == "rf":
                grown = materialize(fo.fit(train, most_depth=config.forest_depth, seed=config.seed), "eval-forest", large_rows=True)
                one = fo.scores(held, grown)
            elif model == "mlp":
                one = _network_scores(train.filter("scaled"), held.filter("scaled"), config, parallelism)
            else:
                raise ValueError(f"unknown model {model!r}")
            scored.append(materialize(one.withColumn("model", F.lit(model)), "eval-scores"))
        table = scored[0]
        for more in scored[1:]:
            table = table.unionByName(more)
        by = ["model", *bt.KEYS]
        auc = materialize(mt.roc_auc(table, by=by), "eval-auc")
        base = [c for c in by if c != "fold"]
        folds = auc.filter(F.col("fold") != bt.TEST_FOLD).groupBy(*base).agg(F.count("auc").cast("int").alias("cv_folds"), F.avg("auc").alias("cv_mean"), (2 * F.stddev_pop("auc")).alias("cv_std"))
        test = auc.filter(F.col("fold") == bt.TEST_FOLD).select(*base, "auc")
        f1 = mt.f1_accuracy(table.filter(F.col("fold") == bt.TEST_FOLD), by=base).select(*base, "f1", "accuracy")
        out = test.join(f1, base).join(folds, base, "left").withColumn("cv_folds", F.coalesce("cv_folds", F.lit(0)))
        return materialize(out.select("region", "model", "feature_set", "scaled", F.col("run").alias("seed"), "cv_folds", "cv_mean", "cv_std", "auc", "f1", "accuracy"), "eval-result", keep=True)


def evaluate_region(frame: DataFrame, region: str | None = None, config: PipelineConfig = PipelineConfig(), models: Sequence[str] = md.MODELS,
                    leaky_scaling: bool = False, min_per_class: int = 5, seeds: Sequence[int] | None = None) -> DataFrame:
    """ML12 for one region, or for all pooled (``region=None``, reported as "(all)"): a row per
    (model, feature_set, scaled, seed).

    Where balancing leaves fewer than ``min_per_class`` rows of a class (in a dense table every
    interval may have an incident) nothing can be trained: the rows say so with 0 folds and
    null metrics.  A named region without any row is an error."""
    df = frame if region is None else frame.filter(F.col("region") == region)
    if region is not None and df.isEmpty():
        raise ValueError(f"no rows of region {region!r}")
    name, seeds = "(all)" if region is None else region, [config.seed] if seeds is None else seeds
    out = evaluate_regions(df, config, models, leaky_scaling, min_per_class, seeds, "(all)" if region is None else None)
    return _all_asked(frame.sparkSession.createDataFrame([(name,)], "region STRING"), out, models, seeds)


def evaluate_each_region(frame: DataFrame, config: PipelineConfig = PipelineConfig(), models: Sequence[str] = md.MODELS,
                         leaky_scaling: bool = False, min_per_class: int = 5, seeds: Sequence[int] | None = None) -> DataFrame:
    """ML12 for each region of ``frame`` by itself, trained together: the rows ``evaluate_region`` has for
    it, also where nothing can be trained."""
    seeds = [config.seed] if seeds is None else seeds
    out = evaluate_regions(frame, config, models, leaky_scaling, min_per_class, seeds)
    return _all_asked(frame.select("region").distinct(), out, models, seeds)


def _all_asked(regions: DataFrame, out: DataFrame, models: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """``out`` with a row for every asked evaluation of ``regions``: 0 folds and null metrics where it has none."""
    asked = [F.struct(F.lit(model).alias("model"), F.lit(feature_set).alias("feature_set"), F.lit(scaled).alias("scaled"), F.lit(seed).alias("seed"))
             for seed in seeds for model in models for feature_set, _ in bt.SETS for scaled in (False, True) if scaled or model != "mlp"]
    rows = regions.select("region", F.explode(F.array(*asked)).alias("one")).select("region", "one.*")
    return rows.join(out, ["region", "model", "feature_set", "scaled", "seed"], "left").withColumn("cv_folds", F.coalesce("cv_folds", F.lit(0)))


def repeat_evaluation(frame: DataFrame, region: str | None, runs: int, config: PipelineConfig = PipelineConfig(),
                      models: Sequence[str] = md.MODELS) -> DataFrame:
    """ML13: seeds 0..runs-1, averaged per (model, feature_set, scaled); all runs train together."""
    return evaluate_region(frame, region, config, models, seeds=range(runs)).groupBy("region", "model", "feature_set", "scaled").agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.avg(c).alias(c) for c in ("cv_folds", "cv_mean", "cv_std", "auc", "f1", "accuracy")],
    )


def comparison_report(results: DataFrame) -> DataFrame:
    """ML14: sparse vs dynamic side by side, with the dynamic-minus-sparse delta."""
    keys = ["region", "model", "scaled"]
    s = results.filter(F.col("feature_set") == "sparse").select(
        *keys, *[F.col(c).alias(f"sparse_{c}") for c in ("cv_mean", "auc", "f1", "accuracy")])
    d = results.filter(F.col("feature_set") == "dynamic").select(
        *keys, *[F.col(c).alias(f"dynamic_{c}") for c in ("cv_mean", "auc", "f1", "accuracy")])
    j = s.join(d, keys)
    return j.select("*", *[(F.col(f"dynamic_{c}") - F.col(f"sparse_{c}")).alias(f"delta_{c}")
                           for c in ("cv_mean", "auc", "f1", "accuracy")])
