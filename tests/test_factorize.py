"""Stratified SGD equals sequential SGD; prediction/cost on hand-given factors; ALS."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionpulse.config import PipelineConfig
from regionpulse.operators import factorize as fz


def _toy(spark, n_rows=12, n_cols=7, density=0.5, seed=3):
    rng = np.random.default_rng(seed)
    cells = [(i, j, float(rng.integers(1, 6)) + rng.random()) for i in range(n_rows) for j in range(n_cols) if rng.random() < density]
    coo = spark.createDataFrame(cells, "i BIGINT, j BIGINT, value DOUBLE")
    rows = spark.createDataFrame([(i,) for i in range(n_rows)], "i BIGINT")
    cols = spark.createDataFrame([(j,) for j in range(n_cols)], "j BIGINT")
    return cells, coo, rows, cols


def _sequential(cells, n_rows, n_cols, cfg, blocks_of_i, blocks_of_j, d, init):
    """Plain per-cell SGD written independently, visiting blocks in stratum order."""
    K, a, b, es = cfg.rank, cfg.learning_rate, cfg.regularization, cfg.error_scale
    P = np.array([init["P", i] for i in range(n_rows)])
    Q = np.array([init["Q", j] for j in range(n_cols)])
    bp, bq = np.zeros(n_rows), np.zeros(n_cols)
    mu = np.mean([v for _, _, v in cells])
    for epoch in range(cfg.epochs):
        for s in range(d):
            for g in range(d):
                blk = sorted((i, j, v) for i, j, v in cells if blocks_of_i[i] == g and blocks_of_j[j] == (g + s) % d)
                if not blk:
                    continue
                order = fz._block_order(len(blk), cfg.seed, epoch, s, g)
                for k in order:
                    i, j, r = blk[k]
                    e = r - (mu + bp[i] + bq[j] + P[i] @ Q[j])
                    bp[i] += a * (e - b * bp[i])
                    bq[j] += a * (e - b * bq[j])
                    P[i] = P[i] + a * (es * e * Q[j] - b * P[i])
                    Q[j] = Q[j] + a * (es * e * P[i] - b * Q[j])
    return P, Q, bp, bq


@pytest.mark.parametrize("d, rank", [(1, 3), (2, 3), (4, 3), (5, 250)])
def test_stratified_sgd_equals_sequential(spark, d, rank):
    cells, coo, rows, cols = _toy(spark)
    cfg = PipelineConfig(rank=rank, learning_rate=0.05, regularization=0.01, epochs=3, blocks=d, seed=7)
    model = fz.densify_sgd(coo, rows, cols, cfg, track_history=False)
    init = {(r["side"], r["id"]): np.array(r["factors"]) for r in fz.init_factors(rows, cols, rank, cfg.seed).collect()}
    if d > 1:
        bi = {r["i"]: r["b"] for r in rows.select("i", F.pmod(F.xxhash64("i"), F.lit(d)).alias("b")).collect()}
        bj = {r["j"]: r["b"] for r in cols.select("j", F.pmod(F.xxhash64("j"), F.lit(d)).alias("b")).collect()}
    else:
        bi, bj = {i: 0 for i in range(12)}, {j: 0 for j in range(7)}
    P, Q, bp, bq = _sequential(cells, 12, 7, cfg, bi, bj, d, init)
    got = {(r["side"], r["id"]): (r["bias"], np.array(r["factors"])) for r in model.factors.collect()}
    for i in range(12):
        assert abs(got[("P", i)][0] - bp[i]) < 1e-9 and np.allclose(got[("P", i)][1], P[i], atol=1e-9)
    for j in range(7):
        assert abs(got[("Q", j)][0] - bq[j]) < 1e-9 and np.allclose(got[("Q", j)][1], Q[j], atol=1e-9)


def test_sgd_loss_falls(spark):
    _, coo, rows, cols = _toy(spark, 20, 10, 0.6)
    cfg = PipelineConfig(rank=4, learning_rate=0.02, regularization=0.001, epochs=6)
    hist = [r["cost"] for r in fz.densify_sgd(coo, rows, cols, cfg).history.orderBy("epoch").collect()]
    assert all(b < a for a, b in zip(hist, hist[1:]))


def test_fixed_factors_prediction_and_cost(spark):
    fac = spark.createDataFrame(
        [("P", 0, 0.1, [1.0, 0.0]), ("P", 1, 0.2, [0.0, 1.0]), ("P", 2, 0.3, [1.0, 1.0]),
         ("Q", 0, -0.1, [1.0, 2.0]), ("Q", 1, 0.1, [3.0, 4.0])], fz.STATE_SCHEMA)
    coo = spark.createDataFrame([(0, 0, 2.0), (2, 1, 9.0)], "i BIGINT, j BIGINT, value DOUBLE")
    pred = {(r["i"], r["j"]): r["prediction"] for r in fz.predict_cells(coo, fac, 1.0).collect()}
    assert pred[(0, 0)] == pytest.approx(1 + 0.1 - 0.1 + 1.0)
    assert pred[(2, 1)] == pytest.approx(1 + 0.3 + 0.1 + 7.0)
    e = fz.fit_error(coo, fac, 1.0, 0.5).first()
    sse = (2.0 - 2.0) ** 2 + (9.0 - 8.4) ** 2
    reg = 1 + 1 + 2 + 5 + 25
    assert e["sse"] == pytest.approx(sse) and e["cost"] == pytest.approx(sse / 2 + 0.25 * reg)
    assert e["root_sse"] == pytest.approx(np.sqrt(sse))


def test_dense_matrix_replaces_every_cell(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame([(t0, "a", 1, 2, 0.0, 0.5, 1.0)],
                              "t TIMESTAMP_NTZ, region STRING, visitor_count BIGINT, obs_freq BIGINT, "
                              "visitor_entropy DOUBLE, visitor_ratio DOUBLE, region_popularity DOUBLE")
    coo, rows, cols = fz.sparse_cells(m)
    assert coo.count() == 4  # the zero entropy cell is missing
    assert cols.count() == 5
    model = fz.densify_sgd(coo, rows, cols, PipelineConfig(rank=2, epochs=2), track_history=False)
    dense = fz.dense_matrix(m, model.factors, model.mean, rows, cols).collect()
    assert len(dense) == 1 and all(dense[0][f] is not None for f in ("visitor_count", "visitor_entropy"))


def test_als_recovers_planted_low_rank(spark):
    rng = np.random.default_rng(0)
    U, V = rng.normal(size=(40, 2)), rng.normal(size=(15, 2))
    X = 3.0 + rng.normal(size=(40, 1)) * 0.3 + rng.normal(size=(1, 15)) * 0.3 + U @ V.T
    mask = rng.random(X.shape) < 0.6
    cells = [(int(i), int(j), float(X[i, j])) for i, j in zip(*np.nonzero(mask))]
    held = [(int(i), int(j), float(X[i, j])) for i, j in zip(*np.nonzero(~mask))]
    coo = spark.createDataFrame(cells, "i BIGINT, j BIGINT, value DOUBLE")
    rows = spark.createDataFrame([(i,) for i in range(40)], "i BIGINT")
    cols = spark.createDataFrame([(j,) for j in range(15)], "j BIGINT")
    model = fz.densify_als(coo, rows, cols, PipelineConfig(rank=2, regularization=0.002), max_iter=20)
    sd = float(np.std([v for _, _, v in cells]))
    err = fz.fit_error(coo, model.factors, model.mean, 0.0).first()
    assert err["rmse"] < 0.15 * sd
    test = spark.createDataFrame(held, "i BIGINT, j BIGINT, value DOUBLE")
    assert fz.fit_error(test, model.factors, model.mean, 0.0).first()["rmse"] < 0.5 * sd


def test_batches_share_no_row_or_column_and_keep_order():
    rng = np.random.default_rng(5)
    ii, jj = rng.integers(0, 9, 80), rng.integers(0, 6, 80)
    batches = fz.conflict_free_batches(ii, jj)
    assert sorted(np.concatenate(batches).tolist()) == list(range(80))
    when = {int(n): k for k, at in enumerate(batches) for n in at}
    for at in batches:
        assert len(set(ii[at])) == len(at) == len(set(jj[at]))
    for a in range(80):
        for b in range(a):
            if ii[a] == ii[b] or jj[a] == jj[b]:
                assert when[b] < when[a]


def test_result_does_not_depend_on_cores_or_partitions(spark):
    _, coo, rows, cols = _toy(spark, 20, 10, 0.6)
    cfg = PipelineConfig(rank=3, epochs=2)
    a, b = (fz.densify_sgd(c, rows, cols, cfg, track_history=False, strata_per_write=w).factors.collect()
            for c, w in ((coo, 3), (coo.repartition(7), 50)))
    key = lambda r: (r["side"], r["id"])
    assert all(np.allclose(x["factors"], y["factors"], atol=1e-12) for x, y in zip(sorted(a, key=key), sorted(b, key=key)))


def test_initial_factors_are_normal_and_seeded(spark):
    ids = spark.range(400).select(F.col("id").alias("i"), F.col("id").alias("j"))
    x = np.array([r["factors"] for r in fz.init_factors(ids, ids, 20, 1).collect()]).ravel() * 20
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs((x ** 4).mean() - 3) < 0.3
    y = np.array([r["factors"] for r in fz.init_factors(ids, ids, 20, 2).collect()]).ravel() * 20
    assert abs(np.corrcoef(np.sort(x[:100]), y[:100])[0, 1]) < 0.5 and not np.allclose(x, y)


def test_rating_without_factors_raises(spark):
    _, coo, rows, cols = _toy(spark)
    with pytest.raises(Exception, match="have no factors"):
        fz.densify_sgd(coo, rows.filter("i > 2"), cols, PipelineConfig(rank=2, epochs=1, blocks=1), track_history=False)


def test_als_predicts_rows_and_columns_without_ratings(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1, 3 * k) for k in range(4)]
    schema = ("t TIMESTAMP_NTZ, region STRING, visitor_count BIGINT, obs_freq BIGINT, "
              "visitor_entropy DOUBLE, visitor_ratio DOUBLE, region_popularity DOUBLE")
    m = spark.createDataFrame([(x, r, 1 + k, 2, 0.5, 0.0, 1.0) for k, x in enumerate(t[:3]) for r in "ab"] + [(t[3], "a", 0, 0, 0.0, 0.0, 0.0)], schema)
    dense, _ = fz.dynamic_features(m, PipelineConfig(rank=2), "als")
    got = dense.collect()  # no visitor_ratio anywhere, nothing at all in the last interval
    assert len(got) == 7 and all(v is not None for r in got for v in r)
    nothing, _ = fz.dynamic_features(m.filter("obs_freq = 0"), PipelineConfig(rank=2), "als")
    assert [r["obs_freq"] for r in nothing.collect()] == [0.0]


def test_large_values_start_again_with_a_smaller_rate(spark):
    """Values 30 times as large make the factors grow beyond bounds at this rate."""
    _, coo, rows, cols = _toy(spark)
    large = coo.withColumn("value", F.col("value") * 30)
    cfg = PipelineConfig(rank=3, learning_rate=0.05, regularization=0.01, epochs=4, blocks=1, seed=7)
    got = fz.densify_sgd(large, rows, cols, cfg, track_history=False).factors.collect()
    assert np.isfinite([[r["bias"], *r["factors"]] for r in got]).all()
