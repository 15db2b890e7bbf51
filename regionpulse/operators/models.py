"""The four classifiers, as MLlib estimators (distributed fits, no driver-side data).

* ``lr``  - L2 logistic regression, C = 1 -> regParam = 1 / (C n), no standardisation.
* ``rf``  - random forest, 200 trees, sqrt features per split, deep trees.
* ``svm`` - RBF kernel approximated by random Fourier features (Rahimi & Recht 2007),
            gamma = 1 / n_features, then a linear SVM with regParam = 1 / (C n).
* ``mlp`` - one hidden layer of 5 units, 2 outputs, batch 32, 100 iterations.

``fit_score`` returns the scored rows with ``score`` (continuous, for AUC) and
``prediction`` (0/1, for F1 and accuracy).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = ("svm", "lr", "rf", "mlp")


def fourier_projection(cols: Sequence[str], components: int = 100, gamma: float | None = None, seed: int = 0):
    """Random Fourier feature parameters: W ~ N(0, 2 gamma I) (D x n), b ~ U(0, 2 pi)."""
    n = len(cols)
    gamma = (1.0 / n) if gamma is None else gamma
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(components, n))
    b = rng.uniform(0.0, 2 * math.pi, size=components)
    return W, b


def fourier_features(df: DataFrame, cols: Sequence[str], components: int = 100, gamma: float | None = None,
                     seed: int = 0, out: str = "features") -> DataFrame:
    """z(x) = sqrt(2/D) cos(W x + b) as one ML vector column.

    The D x n projection is a parameter of fixed size (not data): it is inlined as
    literal arrays and evaluated by one native higher-order expression per row."""
    from pyspark.ml.functions import array_to_vector

    W, b = fourier_projection(cols, components, gamma, seed)
    scale = math.sqrt(2.0 / components)
    x = F.array(*[F.col(c).cast("double") for c in cols])
    rows = F.array(*[F.struct(F.lit(float(b[d])).alias("b"), F.array(*[F.lit(float(w)) for w in W[d]]).alias("w"))
                     for d in range(components)])
    z = F.transform(rows, lambda r: F.lit(scale) * F.cos(r["b"] + F.aggregate(
        F.zip_with(r["w"], x, lambda w, v: w * v), F.lit(0.0), lambda acc, y: acc + y)))
    return df.withColumn(out, array_to_vector(z))


def _estimator(model: str, n_train: int, n_features: int, seed: int, max_depth: int = 30, iterations: int = 100):
    from pyspark.ml.classification import (
        LinearSVC,
        LogisticRegression,
        MultilayerPerceptronClassifier,
        RandomForestClassifier,
    )

    reg = 1.0 / max(n_train, 1)
    if model == "lr":
        return LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=100)
    if model == "svm":
        return LinearSVC(regParam=reg, standardization=False, maxIter=100)
    if model == "rf":
        return RandomForestClassifier(numTrees=200, featureSubsetStrategy="sqrt", maxDepth=max_depth,
                                      minInstancesPerNode=1, seed=seed)
    if model == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 5, 2], blockSize=32, maxIter=iterations, seed=seed)
    raise ValueError(f"unknown model {model!r}")


def fit_score(train: DataFrame, test: DataFrame, cols: Sequence[str], model: str, seed: int = 0,
              label: str = "label", keep: Sequence[str] = (), partitions: int = 8, max_depth: int = 30, components: int = 100,
              iterations: int = 100, threshold: float | None = None) -> DataFrame:
    """Fit ``model`` on ``train`` and score ``test``: (keep..., label, score, prediction).

    ``partitions`` is the number of training partitions: explicit, because bagging and
    summation order depend on it.  ``max_depth`` is the forest's, ``components`` the number of
    random Fourier features, ``iterations`` the network's.  With ``threshold`` the prediction
    is score > threshold instead of the model's own."""
    cols = list(cols)
    if model == "svm":
        def featurize(df):
            return fourier_features(df, cols, components, seed=seed)
        n_features = components
    else:
        asm = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
        featurize = asm.transform
        n_features = len(cols)
    n = train.count()  # of the regularization: 1 / (C n)
    # dealt by content, so the same rows train together whatever the input's layout
    tr = featurize(train.repartition(partitions, *cols, label)).select("features", F.col(label).cast("double").alias("label"))
    est = _estimator(model, n, n_features, seed, max_depth, iterations)
    fitted = est.fit(tr)
    scored = fitted.transform(featurize(test))
    from pyspark.ml.functions import vector_to_array

    if model in ("svm",):
        score = vector_to_array("rawPrediction")[1]
    else:
        score = vector_to_array("probability")[1]
    prediction = F.col("prediction").cast("int") if threshold is None else F.when(score > threshold, 1).otherwise(0)
    return scored.select(*keep, F.col(label).cast("int").alias("label"), score.alias("score"), prediction.alias("prediction"))
