"""Biased matrix factorization of the sparse (interval x feature-region) matrix.

Model: x(i, j) ~ b + b_i + b_j + P_i . Q_j, with b the mean of the non-zero cells.

``densify_sgd`` (default) reproduces per-cell stochastic gradient descent with the
reference's update order (biases first, then P_i, then Q_j with the *updated* P_i;
``error_scale`` 2 on the factor step, 1 on the bias step).  It is distributed as
stratified SGD (Gemulla et al., KDD 2011): rows and columns are hashed into d blocks;
stratum s pairs row block r with column block (r + s) mod d.  Blocks of one stratum
share no row and no column, so they are updated in parallel and one epoch equals a
sequential pass in stratum order.  Inside a block, cells run as array operations in batches
that share no row and no column, which keeps the sequential result.

Row blocks and their ratings stay where they are: both are key-partitioned once, and each
stratum joins the column blocks to them, so a stratum shuffles |Q| bytes and never P.  This
needs a partitioner that survives user code, which a DataFrame loses with every Python
operator: the strata are the library's one use of pair RDDs.  Blocks are packed arrays.
The state is written to the shared checkpoint folder after a bounded number of strata,
which bounds the lineage and the work a lost executor can cost; in between, the row blocks
of a stratum are held by Spark for the next one.

Fitting runs Spark jobs when these functions are called; what they return is lazy again.

``densify_als`` fits the same biased model to convergence: biases by aggregation,
then MLlib ALS on the residuals.

State schema: (side 'P'|'Q', id long, bias double, factors array<double>).
Ratings schema: (i long, j long, value double).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpulse.config import FEATURES, PipelineConfig
from regionpulse.functions import dot
from regionpulse.operators.features import feature_long
from regionpulse.operators.grid import dense_ids
from regionpulse.session import materialize, scratch

STATE_SCHEMA = "side STRING, id BIGINT, bias DOUBLE, factors ARRAY<DOUBLE>"


@dataclass
class FactorModel:
    factors: DataFrame  # STATE_SCHEMA
    mean: float
    rank: int
    history: DataFrame | None = None

    def side(self, s: str) -> DataFrame:
        return self.factors.filter(F.col("side") == s).drop("side")


# ------------------------------------------------------------------ matrix <-> COO

def matrix_ids(matrix: DataFrame, features=FEATURES) -> tuple[DataFrame, DataFrame]:
    """Row ids (t -> i) and column ids ((feature, region) -> j), dense and 0-based,
    columns ordered feature-major like five wide blocks placed side by side."""
    rows = dense_ids(matrix.select("t"), ["t"], "i")
    fidx = F.array(*[F.struct(F.lit(k).alias("fidx"), F.lit(f).alias("feature")) for k, f in enumerate(features)])
    cols = matrix.select("region").distinct().select("region", F.explode(fidx).alias("f")).select(
        F.col("f.fidx").alias("fidx"), F.col("f.feature").alias("feature"), "region"
    )
    cols = dense_ids(cols, ["fidx", "region"], "j").join(cols, ["fidx", "region"])
    return rows.select(F.col("i").cast("long"), "t"), cols.select(F.col("j").cast("long"), "feature", "region")


def sparse_cells(matrix: DataFrame, features=FEATURES, positive_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MF1: non-zero cells as (i, j, value) plus the two id maps."""
    rows, cols = matrix_ids(matrix, features)
    long = feature_long(matrix.select("t", "region", *features))
    keep = F.col("value") > 0 if positive_only else F.col("value") != 0
    coo = long.filter(keep).join(rows, "t").join(cols, ["feature", "region"]).select("i", "j", "value")
    return coo, rows, cols


def nonzero_mean(coo: DataFrame) -> DataFrame:
    """AG15: one-row DataFrame with the mean of the stored (non-zero) cells."""
    return coo.agg(F.avg("value").alias("mean"))


# ------------------------------------------------------------------ prediction & cost

def predict_cells(cells: DataFrame, factors: DataFrame, mean) -> DataFrame:
    """MF5: b + b_i + b_j + P_i . Q_j for the requested (i, j) cells."""
    p = factors.filter(F.col("side") == "P").select(F.col("id").alias("i"), F.col("bias").alias("bi"), F.col("factors").alias("pi"))
    q = factors.filter(F.col("side") == "Q").select(F.col("id").alias("j"), F.col("bias").alias("bj"), F.col("factors").alias("qj"))
    m = mean if hasattr(mean, "_jc") else F.lit(float(mean))
    j = cells.join(p, "i").join(q, "j")
    return j.withColumn("prediction", m + F.col("bi") + F.col("bj") + dot("pi", "qj")).drop("bi", "bj", "pi", "qj")


def fit_error(coo: DataFrame, factors: DataFrame, mean, beta: float) -> DataFrame:
    """MF7 / MF8: one row (n, sse, rmse, root_sse, cost) on the observed cells.

    cost = sse / 2 + beta / 2 (|P|^2 + |Q|^2); biases are not in the cost.
    ``root_sse`` is the class variant's "mse" (square root of the sum)."""
    pred = predict_cells(coo, factors, mean)
    err = pred.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("value") - F.col("prediction"), 2)).alias("sse"))
    reg = factors.agg(F.sum(dot("factors", "factors")).alias("reg")).select("reg").scalar()
    return err.withColumn("reg", reg).select(
        "n", "sse",
        F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("rmse"),
        F.sqrt("sse").alias("root_sse"),
        (F.col("sse") / 2 + F.lit(beta / 2) * F.col("reg")).alias("cost"),
    )


def dense_matrix(matrix: DataFrame, factors: DataFrame, mean, rows: DataFrame, cols: DataFrame, features=FEATURES,
                 keep_observed: bool = False) -> DataFrame:
    """MF6 + MF10: predicted value of every cell of ``matrix`` (its (t, region) rows),
    relabelled to (t, region, <features>).  One row of ``matrix`` needs the factor row
    of its interval and the five column factors of its region; both come in by
    equi-joins, never by a cross product."""
    p = factors.filter(F.col("side") == "P").select(F.col("id").alias("i"), F.col("bias").alias("bi"), F.col("factors").alias("pi"))
    q = factors.filter(F.col("side") == "Q").select(F.col("id").alias("j"), F.col("bias").alias("bj"), F.col("factors").alias("qj"))
    qcols = cols.join(q, "j").groupBy("region").agg(
        *[F.first(F.when(F.col("feature") == f, F.struct("bj", "qj")), ignorenulls=True).alias(f"_q_{f}") for f in features]
    )
    m = mean if hasattr(mean, "_jc") else F.lit(float(mean))
    j = matrix.join(rows, "t").join(p, "i").join(qcols, "region")
    out = []
    for f in features:
        pred = m + F.col("bi") + F.col(f"_q_{f}.bj") + dot("pi", F.col(f"_q_{f}.qj"))
        if keep_observed:
            pred = F.when(F.col(f) != 0, F.col(f).cast("double")).otherwise(pred)
        out.append(pred.alias(f))
    return j.select("t", "region", *out)


# ------------------------------------------------------------------ initialisation

def gauss(seed: int, side, ident, k, rank: int):
    """N(0, 1/rank) from a hash of (seed, side, id, k): two uniforms, Box-Muller."""
    def uniform(which: int):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), side, ident, k, F.lit(which)), 11)
        return (bits + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.sqrt(-2.0 * F.log(uniform(0))) * F.cos(F.lit(2 * math.pi) * uniform(1)) / F.lit(float(rank))


def init_factors(rows: DataFrame, cols: DataFrame, rank: int, seed: int = 0) -> DataFrame:
    """MF9: N(0, 1/K) factors (a function of seed, side, id and place), zero biases."""
    ids = rows.select(F.lit("P").alias("side"), F.col("i").cast("long").alias("id")).unionByName(
        cols.select(F.lit("Q").alias("side"), F.col("j").cast("long").alias("id"))
    )
    facs = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda k: gauss(seed, F.col("side"), F.col("id"), k, rank))
    return ids.select("side", "id", F.lit(0.0).alias("bias"), facs.alias("factors"))


# ------------------------------------------------------------------ stratified SGD

def conflict_free_batches(ii: np.ndarray, jj: np.ndarray) -> list[np.ndarray]:
    """Positions of an ordered list of cells in batches that share no row and no column.

    A cell goes one batch after the last earlier cell of its row or column, so running the
    batches in order, each at once, gives what running the cells one by one gives."""
    row_next: dict[int, int] = {}
    col_next: dict[int, int] = {}
    batch = np.empty(len(ii), np.int64)
    for n, (i, j) in enumerate(zip(ii.tolist(), jj.tolist())):
        at = max(row_next.get(i, 0), col_next.get(j, 0))
        batch[n] = at
        row_next[i] = col_next[j] = at + 1
    order = np.argsort(batch, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(batch[order])) + 1) if len(order) else []


def update_batches(mean, P, Q, bp, bq, ii, jj, vv, alpha, beta, error_scale) -> None:
    """MF4, in place: biases first, then row factors, then column factors from the new row factors."""
    for at in conflict_free_batches(ii, jj):
        i, j = ii[at], jj[at]
        p, q, b_i, b_j = P[i], Q[j], bp[i], bq[j]
        miss = vv[at] - (mean + b_i + b_j + np.einsum("nk,nk->n", p, q))
        bp[i] = b_i + alpha * (miss - beta * b_i)
        bq[j] = b_j + alpha * (miss - beta * b_j)
        step = (error_scale * miss)[:, None]
        p = p + alpha * (step * q - beta * p)
        P[i] = p
        Q[j] = q + alpha * (step * p - beta * q)


def _positions(index: pd.Index, ids: np.ndarray, side: str) -> np.ndarray:
    at = index.get_indexer(ids)
    if len(at) and at.min() < 0:
        raise ValueError(f"ratings name {side} ids that have no factors: {ids[at < 0][:5].tolist()}")
    return at


def _block_order(n: int, seed: int, epoch: int, stratum: int, block: int) -> np.ndarray:
    return np.random.default_rng([seed, 1 + epoch, stratum, block]).permutation(n)


def _packed_blocks(state: DataFrame, d: int, rank: int) -> DataFrame:
    """(side, block, ids, bias, factors): the rows of each block in order of their id, packed."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bias, factors = (batch.column(k) for k in (2, 3, 4))
            packed = [[np.asarray(column[k].values.flatten() if deep else column[k].values).astype(kind).tobytes() for k in range(batch.num_rows)]
                      for column, deep, kind in ((ids, False, np.int64), (bias, False, np.float64), (factors, True, np.float64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.binary()) for x in packed]], names=["side", "block", "ids", "bias", "factors"])

    rows = F.array_sort(F.collect_list(F.struct("id", "bias", "factors")))
    held = state.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(d)).cast("int")).groupBy("side", "block").agg(rows.alias("r"))
    lists = [F.col("r").getField(c).alias(c) for c in ("id", "bias", "factors")]  # arrays of one field
    return held.select("side", "block", *lists).mapInArrow(pack, "side string, block int, ids binary, bias binary, factors binary")


def _unpacked(blocks: DataFrame, rank: int) -> DataFrame:
    """STATE_SCHEMA rows of packed blocks."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, _, ids, bias, factors in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.frombuffer(ids, np.int64)
                flat = pa.array(np.frombuffer(factors, np.float64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * rank), flat)
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(ids), pa.string()), pa.array(ids), pa.array(np.frombuffer(bias, np.float64)), lists], names=["side", "id", "bias", "factors"])

    return blocks.select("side", "block", "ids", "bias", "factors").mapInArrow(unpack, STATE_SCHEMA)


def _make_update(mean, alpha, beta, error_scale, seed, epoch, stratum, shuffle, rank):
    def update(rows, cols, ratings):
        """New (ids, bias, factors) of a row block and a column block after their ratings."""
        if rows is None or cols is None or ratings is None:
            if ratings is not None:
                raise ValueError("ratings name ids that have no factors")
            return rows, cols
        (pi, bp, P), (qi, bq, Q) = ((np.frombuffer(x[0], np.int64), np.frombuffer(x[1], np.float64).copy(), np.frombuffer(x[2], np.float64).reshape(-1, rank).copy()) for x in (rows, cols))
        i, j, v = (np.frombuffer(x, kind) for x, kind in zip(ratings, (np.int64, np.int64, np.float64)))
        order = _block_order(len(i), seed, epoch, stratum[0], stratum[1]) if shuffle else np.arange(len(i))
        ii, jj = _positions(pd.Index(pi), i, "row")[order], _positions(pd.Index(qi), j, "column")[order]
        update_batches(mean, P, Q, bp, bq, ii, jj, v[order], alpha, beta, error_scale)
        return (rows[0], bp.tobytes(), P.tobytes()), (cols[0], bq.tobytes(), Q.tobytes())

    return update


def _packed_ratings(ratings: DataFrame, d: int):
    """Pair RDD row block -> {column block: (i, j, value)}, packed and ordered by (i, j)."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "value")))
    blocks = ratings.groupBy("rb", "cb").agg(cells.alias("r"))
    lists = [F.col("r").getField(c).alias(c) for c in ("i", "j", "value")]

    def pack(r):
        return r["rb"], (r["cb"], tuple(np.array(r[c], kind).tobytes() for c, kind in (("i", np.int64), ("j", np.int64), ("value", np.float64))))

    pairs = blocks.select("rb", "cb", *lists).rdd.map(pack)
    return pairs.partitionBy(d, int).mapPartitions(lambda rows: iter(_by_row_block(rows).items()), preservesPartitioning=True)


def _by_row_block(rows) -> dict:
    held: dict = {}
    for g, (c, cells) in rows:
        held.setdefault(g, {})[c] = cells
    return held


def densify_sgd(
    coo: DataFrame,
    rows: DataFrame,
    cols: DataFrame,
    config: PipelineConfig = PipelineConfig(),
    track_history: bool = True,
    shuffle: bool = True,
    init: DataFrame | None = None,
    strata_per_write: int = 20,
) -> FactorModel:
    """MF2 + MF4 + MF8 + MF9: stratified distributed SGD; returns the fitted model.

    ``config.blocks`` (d) decides the visiting order and so the fitted numbers; neither data
    size nor cores do.  The state is written after every ``strata_per_write`` strata (and
    after the last, and each epoch when the history is tracked), which is all that a lost
    executor can cost.

    On large values the learning rate can be too large, and the factors grow beyond all
    bounds.  A run whose written state shows that starts again with a quarter of the rate;
    a run from given factors (``init``) is done as asked."""
    bound = None
    if init is None:
        bound = 10.0 * (1.0 + float(coo.agg(F.max(F.abs("value"))).first()[0] or 0.0))
    for _ in range(12):
        model = _sgd_run(coo, rows, cols, config, track_history, shuffle, init, strata_per_write, bound)
        if model is not None:
            return model
        config = replace(config, learning_rate=config.learning_rate / 4)
    raise FloatingPointError(f"the factorization diverges even at a learning rate of {config.learning_rate * 4}")


def _sgd_run(coo: DataFrame, rows: DataFrame, cols: DataFrame, config: PipelineConfig, track_history: bool, shuffle: bool,
             init: DataFrame | None, strata_per_write: int, bound: float | None) -> FactorModel | None:
    """One run at the rate of ``config``; None if a bias or factor passes ``bound`` or is not a number."""
    spark = coo.sparkSession
    alpha, beta, es, d = config.learning_rate, config.regularization, float(config.error_scale), config.blocks
    stats = coo.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).first()
    mean = float(stats["mean"] or 0.0)

    def block(c):
        return F.pmod(F.xxhash64(F.col(c)), F.lit(d)).cast("int")

    start = init if init is not None else init_factors(rows, cols, config.rank, config.seed)
    shape = start.agg(F.max(F.size("factors"))).first()[0]
    rank = config.rank if shape is None else shape
    history = []
    packed_schema = "side STRING, block INT, ids BINARY, bias BINARY, factors BINARY"
    with scratch(spark):
        # ratings with their blocks, written once
        ratings = materialize(coo.select(
            F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"),
        ).withColumn("rb", block("i")).withColumn("cb", block("j")), "sgd-ratings")
        state = materialize(_packed_blocks(start, d, rank), "sgd-state")
        cells = _packed_ratings(ratings, d).persist(StorageLevel.DISK_ONLY)

        def sides(table: DataFrame):
            pairs = table.rdd.map(lambda r: (r["side"], r["block"], (bytes(r["ids"]), bytes(r["bias"]), bytes(r["factors"]))))
            return (pairs.filter(lambda x: x[0] == "P").map(lambda x: (x[1], x[2])).partitionBy(d, int),
                    pairs.filter(lambda x: x[0] == "Q").map(lambda x: (x[1], x[2])))

        (p, q), held, pending = sides(state), [], 0
        for epoch in range(config.epochs):
            for s in range(d):
                def stratum(_, parts, epoch=epoch, s=s):
                    """One partition: its row block, its ratings, and the column block that came in."""
                    kinds: dict = {}
                    for g, (kind, value) in parts:
                        kinds.setdefault(g, {})[kind] = value
                    for g, x in kinds.items():
                        c = (g + s) % d
                        update = _make_update(mean, alpha, beta, es, config.seed, epoch, (s, g), shuffle, rank)
                        yield g, update(x.get("P"), x.get("Q"), x.get("R", {}).get(c))

                # all three have the same partitioner: the union keeps it, and only Q was moved
                moved = q.map(lambda x, s=s: ((x[0] - s) % d, ("Q", x[1]))).partitionBy(d, int)
                stay = p.mapValues(lambda v: ("P", v)).union(cells.mapValues(lambda v: ("R", v)))
                out = stay.union(moved).mapPartitionsWithIndex(stratum, preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)
                held.append(out)
                p = out.filter(lambda x: x[1][0] is not None).mapValues(lambda v: v[0])
                q = out.filter(lambda x: x[1][1] is not None).map(lambda x, s=s: ((x[0] + s) % d, x[1][1]))
                pending += 1
                end = s == d - 1
                if pending >= strata_per_write or end and (track_history or epoch == config.epochs - 1):
                    both = p.map(lambda x: ("P", x[0], *map(bytearray, x[1]))).union(q.map(lambda x: ("Q", x[0], *map(bytearray, x[1]))))
                    state = materialize(spark.createDataFrame(both, packed_schema), "sgd-state")  # lineage cut + recovery point
                    for old in held:
                        old.unpersist()
                    (p, q), held, pending = sides(state), [], 0
                    beyond = lambda c: ~(F.abs(c) <= F.lit(bound))
                    if bound is not None and _unpacked(state, rank).filter(beyond(F.col("bias")) | F.exists("factors", beyond)).limit(1).count():
                        cells.unpersist()
                        return None
            if track_history:
                h = fit_error(ratings.select("i", "j", "value"), _unpacked(state, rank), mean, beta).first()
                history.append((epoch, int(h["n"]), float(h["sse"] or 0.0), float(h["rmse"] or 0.0), float(h["root_sse"] or 0.0), float(h["cost"] or 0.0)))
        cells.unpersist()
        fitted = materialize(_unpacked(state, rank), "sgd-factors", keep=True)
    hist_df = spark.createDataFrame(history, "epoch INT, n BIGINT, sse DOUBLE, rmse DOUBLE, root_sse DOUBLE, cost DOUBLE") if track_history else None
    return FactorModel(fitted, mean, rank, hist_df)


# ------------------------------------------------------------------ ALS alternative

def densify_als(
    coo: DataFrame,
    rows: DataFrame,
    cols: DataFrame,
    config: PipelineConfig = PipelineConfig(),
    bias_damping: float = 1.0,
    max_iter: int = 10,
) -> FactorModel:
    """MF3: converged biased fit.  Mean and damped biases by aggregation, then ALS on
    the residuals with regParam = beta / error_scale (ALS scales the penalty by the
    number of ratings, like a per-cell SGD pass does)."""
    from pyspark.ml.recommendation import ALS

    spark = coo.sparkSession
    mean = float(coo.agg(F.avg("value")).first()[0] or 0.0)
    bi = coo.groupBy("i").agg((F.sum(F.col("value") - mean) / (F.count(F.lit(1)) + bias_damping)).alias("bi"))
    r1 = coo.join(bi, "i")
    bj = r1.groupBy("j").agg((F.sum(F.col("value") - mean - F.col("bi")) / (F.count(F.lit(1)) + bias_damping)).alias("bj"))
    resid = r1.join(bj, "j").select(
        F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
        (F.col("value") - mean - F.col("bi") - F.col("bj")).alias("r"),
    )
    resid = materialize(resid, "als-resid")
    als = ALS(
        rank=config.rank, maxIter=max_iter, regParam=config.regularization / float(config.error_scale),
        userCol="i", itemCol="j", ratingCol="r", nonnegative=False, seed=config.seed,
        coldStartStrategy="nan", checkpointInterval=5,
    )
    model = als.fit(resid) if resid.limit(1).count() else None  # nothing to fit: every cell is the mean
    to_d = F.transform("features", lambda x: x.cast("double"))

    def side(name: str, ids: DataFrame, key: str, fitted: DataFrame, bias: DataFrame, bias_name: str) -> DataFrame:
        # ids without a rating: zero factors and bias, so their cells are predicted too
        return (ids.select(F.col(key).cast("long").alias("id")).distinct()
                .join(fitted.select(F.col("id").cast("long").alias("id"), to_d.alias("factors")), "id", "left")
                .join(bias.select(F.col(key).cast("long").alias("id"), F.col(bias_name).alias("bias")), "id", "left")
                .select(F.lit(name).alias("side"), "id", F.coalesce("bias", F.lit(0.0)).alias("bias"),
                        F.coalesce("factors", F.array_repeat(F.lit(0.0), config.rank)).alias("factors")))

    empty = spark.createDataFrame([], "id INT, features ARRAY<FLOAT>")
    user, item = (model.userFactors, model.itemFactors) if model else (empty, empty)
    facs = side("P", rows, "i", user, bi, "bi").unionByName(side("Q", cols, "j", item, bj, "bj"))
    return FactorModel(materialize(facs, "als-factors"), mean, config.rank)


# ------------------------------------------------------------------ whole step

def dynamic_features(matrix: DataFrame, config: PipelineConfig = PipelineConfig(), method: str = "sgd",
                     features=FEATURES, track_history: bool = False) -> tuple[DataFrame, FactorModel]:
    """MF10: factorize the (already low-activity-filtered) matrix and return the dense
    (t, region, <features>) table plus the model.  The per-epoch cost (one extra job
    per epoch) is only computed when ``track_history`` is set."""
    coo, rows, cols = sparse_cells(matrix, features)
    if method == "sgd":
        model = densify_sgd(coo, rows, cols, config, track_history=track_history)
    elif method == "als":
        model = densify_als(coo, rows, cols, config)
    else:
        raise ValueError(f"unknown method {method!r}")
    dense = dense_matrix(matrix, model.factors, model.mean, rows, cols, features, config.keep_observed)
    return dense, model


def matrix_shape(matrix: DataFrame, rank: int, features=FEATURES) -> DataFrame:
    """ML15: (n_rows, n_columns, rank) of the wide view of the long matrix."""
    return matrix.agg(
        F.count_distinct("t").alias("n_rows"),
        (F.count_distinct("region") * len(features)).alias("n_columns"),
    ).withColumn("rank", F.lit(rank))
