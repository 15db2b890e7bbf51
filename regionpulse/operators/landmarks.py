"""ML5: RBF support vector machines of many fits by landmarks (Nystroem features).

Of every fit, ``landmarks`` training rows are drawn by a seeded hash.  With K the kernel
matrix of the landmarks, k(x) the kernel values between x and them, the features
z(x) = K^(-1/2) k(x) have z(x) . z(y) equal to the kernel's best approximation in the span
of the landmarks, and equal to the kernel itself where every distinct row is a landmark.

The linear machine on z (hinge loss, cost C, a constant feature as bias) is solved in the
dual: blocks of rows run coordinate ascent side by side, each with its own dual variables,
and add up their changes of the weights (CoCoA+, Ma et al. 2015).  One job per pass updates
all blocks of all fits; a fit of one block is plain dual coordinate ascent.  Features are
written once, packed; a pass moves weights and dual variables only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from regionpulse.operators.batched import KEYS, X, blocks
from regionpulse.session import materialize, scratch


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


def projection(points: np.ndarray, gamma: float) -> np.ndarray:
    """K^(-1/2) of the landmarks, directions of no weight left out: (landmarks, rank)."""
    value, vector = np.linalg.eigh(kernel(points, points, gamma))
    some = value > 1e-10 * max(value.max(), 1e-300)
    return vector[:, some] / np.sqrt(value[some])


def features(x: np.ndarray, points: np.ndarray, gamma: float) -> np.ndarray:
    return np.hstack([kernel(x, points, gamma) @ projection(points, gamma), np.ones((len(x), 1))])


def local_pass(z: np.ndarray, y: np.ndarray, alpha: np.ndarray, w: np.ndarray, cost: float, spread: int, epochs: int) -> None:
    """Coordinate ascent on one block, in place on ``alpha``, against weights ``w`` of all
    blocks; ``spread`` blocks add up, so each takes its own change that many times."""
    square = (z * z).sum(axis=1) * spread
    own = w.copy()
    order = np.random.default_rng(len(y)).permutation(len(y))
    for _ in range(epochs):
        for i in order.tolist():
            row = z[i]
            new = min(max(alpha[i] + (1 - y[i] * (row @ own)) / square[i], 0.0), cost)
            change = new - alpha[i]
            if change:
                alpha[i] = new
                own += (spread * change * y[i]) * row


def _matrix(packed: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(packed[k].as_buffer(), np.float64)


def fit(train: DataFrame, by: Sequence[str] = KEYS, columns: Sequence[str] = X, landmarks: int = 100, gamma: float | None = None, cost: float = 1.0,
        passes: int = 10, epochs: int = 10, block_rows: int = 2048, seed: int = 0) -> DataFrame:
    """(by..., points, w): landmarks and weights of every fit, packed doubles."""
    by, d = list(by), len(columns)
    gamma = 1.0 / d if gamma is None else gamma
    spark = train.sparkSession
    with scratch(spark):
        order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.lit("landmark"), *columns), *columns)
        some = train.select(*by, *columns).distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= landmarks)
        point = F.sort_array(F.collect_list(F.struct("rank", F.array(*columns).alias("x"))))
        points = materialize(some.groupBy(*by).agg(F.flatten(F.transform(point, lambda p: p["x"])).alias("points")), "svm-landmarks")

        def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.schema.get_field_index
                out, sign = [], []
                for k in range(batch.num_rows):
                    x, p = (np.array(batch.column(n(c))[k].values).reshape(-1, d) for c in ("x", "points"))
                    out.append(features(x, p, gamma).tobytes())
                    sign.append(np.where(np.array(batch.column(n("label"))[k].values) > 0.5, 1.0, -1.0).tobytes())
                columns_ = [batch.column(n(c)) for c in [*by, "n_blocks", "block"]]
                yield pa.RecordBatch.from_arrays([*columns_, pa.array(sign, pa.binary()), pa.array(out, pa.binary())], names=[*by, "n_blocks", "block", "y", "z"])

        types = {f.name: f.dataType.simpleString() for f in train.schema}
        key_fields = ", ".join(f"`{b}` {types[b]}" for b in by)
        dealt = blocks(train, by, columns, block_rows, seed=seed).join(points, by)
        table = materialize(dealt.mapInArrow(featurize, f"{key_fields}, n_blocks int, block int, y binary, z binary"), "svm-blocks", large_rows=True)

        def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.schema.get_field_index
                duals, parts = [], []
                for k in range(batch.num_rows):
                    y = _matrix(batch.column(n("y")), k)
                    z = _matrix(batch.column(n("z")), k).reshape(len(y), -1)
                    old, w = batch.column(n("alpha"))[k], batch.column(n("w"))[k]
                    alpha = np.array(old.values) if old.is_valid else np.zeros(len(y))
                    w = np.array(w.values) if w.is_valid else np.zeros(z.shape[1])
                    local_pass(z, y, alpha, w, cost, batch.column(n("n_blocks"))[k].as_py(), epochs)
                    duals.append(alpha)
                    parts.append((alpha * y) @ z)
                lists = [pa.array(v, pa.list_(pa.float64())) for v in (duals, parts)]
                yield pa.RecordBatch.from_arrays([*[batch.column(n(c)) for c in [*by, "block"]], *lists], names=[*by, "block", "alpha", "part"])

        def weights(duals: DataFrame) -> DataFrame:
            sums = duals.select(*by, F.posexplode("part").alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
            return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("w"))

        empty = F.lit(None).cast("array<double>")
        duals = None
        for _ in range(passes):
            held = (table.withColumn("alpha", empty).withColumn("w", empty) if duals is None
                    else table.join(duals.select(*by, "block", "alpha"), [*by, "block"]).join(weights(duals), by))
            duals = materialize(held.mapInArrow(ascend, f"{key_fields}, block int, alpha array<double>, part array<double>"), "svm-duals")
        return materialize(points.join(weights(duals), by), "svm-weights", keep=True)


def scores(held: DataFrame, model: DataFrame, by: Sequence[str] = KEYS, columns: Sequence[str] = X, gamma: float | None = None, block_rows: int = 2048) -> DataFrame:
    """(by..., label, score, prediction): score is the decision value."""
    by, d = list(by), len(columns)
    gamma = 1.0 / d if gamma is None else gamma

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.schema.get_field_index
            for k in range(batch.num_rows):
                x, p = (np.array(batch.column(n(c))[k].values).reshape(-1, d) for c in ("x", "points"))
                score = features(x, p, gamma) @ np.array(batch.column(n("w"))[k].values)
                at = pa.array(np.full(len(x), k))
                label = pa.array(np.array(batch.column(n("label"))[k].values).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(n(b)).take(at) for b in by], label, pa.array(score), pa.array((score > 0).astype(np.int32))], names=[*by, "label", "score", "prediction"])

    types = {f.name: f.dataType.simpleString() for f in held.schema}
    fields = ", ".join(f"`{b}` {types[b]}" for b in by)
    return blocks(held, by, columns, block_rows).join(model, by).mapInArrow(run, f"{fields}, label int, score double, prediction int")
