"""Hand-sized tables for the semantic traps of the feature operators."""

import datetime as dt

from pyspark.sql import functions as F

from regionpulse.config import PipelineConfig
from regionpulse.operators import features as feat
from regionpulse.operators import grid

SCHEMA = "user_id BIGINT, venue_id BIGINT, region STRING, ts TIMESTAMP_NTZ, seq BIGINT"


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_spine_has_no_gaps(spark):
    rows = [(1, 1, "a", ts("2012-04-03 18:00:09"), 0), (1, 1, "a", ts("2012-04-03 19:00:00"), 1),
            (2, 2, "a", ts("2012-04-04 04:00:00"), 2), (2, 2, "a", ts("2012-04-04 04:10:00"), 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["t"]: r["n"] for r in grid.interval_spine(df).collect()}
    assert out == {ts("2012-04-03 18:00:00"): 2, ts("2012-04-03 21:00:00"): 0,
                   ts("2012-04-04 00:00:00"): 0, ts("2012-04-04 03:00:00"): 2}


def test_bins_are_left_closed(spark):
    rows = [(1, 1, "a", ts("2012-04-03 18:00:00"), 0), (1, 1, "a", ts("2012-04-03 17:59:59.999999"), 1)]
    df = feat.binned_checkins(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r["ts"], r["t"]) for r in df.collect())
    assert got[0][1] == ts("2012-04-03 15:00:00") and got[1][1] == ts("2012-04-03 18:00:00")


def test_null_keys_dropped(spark):
    rows = [(None, 1, "a", ts("2012-04-03 18:00:00"), 0), (1, 1, None, ts("2012-04-03 18:00:00"), 1),
            (1, 1, "a", None, 2), (1, 1, "a", ts("2012-04-03 18:30:00"), 3)]
    b = feat.binned_checkins(spark.createDataFrame(rows, SCHEMA))
    obs = feat.obs_freq(b).collect()
    assert [(r["region"], r["obs_freq"]) for r in obs] == [("a", 1)]  # null user not counted
    vc = feat.visitor_count(b).collect()
    assert vc[0]["visitor_count"] == 1


def test_one_visit_user_entropy_is_positive_zero(spark):
    rows = [(7, 1, "a", ts("2012-04-03 18:00:00"), 0), (7, 2, "a", ts("2012-04-03 19:00:00"), 1)]
    e = feat.visitor_entropy(feat.binned_checkins(spark.createDataFrame(rows, SCHEMA))).collect()
    v = e[0]["visitor_entropy"]
    assert v == 0.0 and str(v) == "0.0"


def test_entropy_uses_all_time_user_totals(spark):
    # user 1: 1 visit in cell A, 3 elsewhere -> p = 1/4 -> -p log2 p = 0.5
    rows = [(1, 1, "a", ts("2012-04-03 18:00:00"), 0)] + [(1, 1, "b", ts("2012-04-04 18:00:00"), i) for i in range(1, 4)]
    e = feat.visitor_entropy(feat.binned_checkins(spark.createDataFrame(rows, SCHEMA)))
    got = {r["region"]: r["visitor_entropy"] for r in e.collect()}
    assert abs(got["a"] - 0.5) < 1e-12


def test_top_venues_ties_by_venue_id(spark):
    rows = [(1, v, "a", ts("2012-04-03 18:00:00"), v) for v in (9, 3, 5, 1, 7, 2)]
    b = feat.binned_checkins(spark.createDataFrame(rows, SCHEMA))
    top = feat.top_venues(feat.user_venue_count(b), 4).collect()
    assert sorted(r["venue_id"] for r in top) == [1, 2, 3, 5]


def test_first_visit_is_earliest_then_file_order(spark):
    rows = [(1, 1, "a", ts("2012-04-05 18:00:00"), 0), (1, 1, "b", ts("2012-04-03 18:00:00"), 5),
            (1, 1, "c", ts("2012-04-03 18:00:00"), 2)]
    fv = feat.first_visits(feat.binned_checkins(spark.createDataFrame(rows, SCHEMA)), 4).collect()
    assert fv[0]["region"] == "c"


def test_feature_matrix_invariants(spark):
    from tests.conftest import SF0001
    from regionpulse.sources import testdata as td

    m = feat.feature_matrix(td.event_checkins(spark, SF0001), PipelineConfig())
    pop = m.groupBy("t").agg(F.sum("region_popularity").alias("s"), F.sum("obs_freq").alias("n")).collect()
    for r in pop:
        assert (r["n"] == 0 and r["s"] == 0) or abs(r["s"] - 1.0) < 1e-9
    bad = m.filter((F.col("visitor_count") > F.col("obs_freq")) | (F.col("visitor_ratio") > 1) | (F.col("visitor_ratio") < 0)).count()
    assert bad == 0
    ck = td.event_checkins(spark, SF0001)
    n_users = ck.select("user_id").distinct().count()
    fv_total = feat.first_visits(feat.binned_checkins(ck), 4).count()
    assert fv_total <= 4 * n_users


def test_low_activity_totals_from_unfiltered(spark):
    rows = [(1, 1, "a", ts("2012-04-03 18:00:00"), i) for i in range(3)] + [(2, 2, "b", ts("2012-04-03 21:00:00"), 9)]
    m = feat.feature_matrix(spark.createDataFrame(rows, SCHEMA), PipelineConfig())
    kept = grid.low_activity_filter(m, None, min_interval_obs=2, min_region_obs=2).collect()
    assert {(r["t"], r["region"]) for r in kept} == {(ts("2012-04-03 18:00:00"), "a")}


def test_materialized_and_lazy_matrix_agree(spark):
    from tests.conftest import SF0001
    from regionpulse.sources import testdata as td

    ck = td.event_checkins(spark, SF0001)
    from regionpulse.plans.queries import rounded

    # the written aggregate gives what the single operators give on the events
    m = rounded(feat.feature_matrix(ck, PipelineConfig()).filter("obs_freq > 0").select("t", "region", "visitor_count", "obs_freq", "visitor_entropy"), 9)
    b = feat.binned_checkins(ck)
    one = rounded(feat.visitor_count(b).join(feat.obs_freq(b), ["t", "region"]).join(feat.visitor_entropy(b), ["t", "region"]), 9)
    assert m.count() == one.count() and m.exceptAll(one).count() == 0


def test_approximate_visitor_count_close(spark):
    from tests.conftest import SF001
    from regionpulse.sources import testdata as td

    b = feat.binned_checkins(td.event_checkins(spark, SF001))
    exact = {(r["t"], r["region"]): r["visitor_count"] for r in feat.visitor_count(b).collect()}
    approx = {(r["t"], r["region"]): r["visitor_count"] for r in feat.visitor_count(b, approximate=True).collect()}
    assert exact.keys() == approx.keys()
    assert sum(abs(exact[k] - approx[k]) for k in exact) <= 0.02 * sum(exact.values())
