"""Driver contract, SQL oracles on the smallest tables, and the streaming aggregates."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF0001 = "/root/testdata/sf0.001"


def test_entry_returns_feature_matrix(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["t", "region", "visitor_count", "obs_freq", "visitor_entropy", "visitor_ratio", "region_popularity"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())


ORACLE_SAMPLE = ["feature_matrix", "logistic_regions", "sgd_epoch", "history_given", "given_features", "model_table", "report_given", "first_visits", "cv_auc", "streaming_obs_freq", "load_checkin_points", "visitor_ratio", "assign_region", "parse_incident_time", "align_features_labels",
                 "area_incident_density", "roc_auc", "undersample", "fit_error", "vector_cosine"]


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_query_matches_sql_oracle(spark, name):
    import duckdb
    import oracle_compare as oc

    import __spark_entry__ as E

    con = duckdb.connect()
    for t in oc.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    s = oc.digest(E.queries()[name](spark, SF0001).toPandas())
    d = oc.digest(con.sql(E.oracle_sql()[name]).df())
    assert s[:3] == d[:3]


def test_streaming_counts_equal_batch(spark, tmp_path):
    from regionpulse import streaming as st
    from regionpulse.operators import features as feat
    from regionpulse.sources import testdata as td

    ck = td.event_checkins(spark, SF0001)
    src = str(tmp_path / "src")
    ck.write.parquet(src)  # one batch; arrival order is irrelevant within a micro-batch
    stream = st.read_checkin_stream(spark, src, ck.schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " "))
    q = st.upsert_stream_to_table(st.streaming_cell_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r["t"], r["region"]): r["obs_freq"] for r in st.latest_bins(spark, str(tmp_path / "out")).collect()}
    want = {(r["t"], r["region"]): r["obs_freq"] for r in feat.obs_freq(feat.binned_checkins(ck)).collect()}
    assert got == want  # bins still open at the end of the input included


def test_streaming_bins_that_grow_over_batches(spark, tmp_path):
    import datetime as dt

    from regionpulse import streaming as st

    schema = "user_id BIGINT, region STRING, ts TIMESTAMP_NTZ"
    at = lambda h: dt.datetime(2024, 1, 1, h, 30)
    src = str(tmp_path / "src")
    for rows in ([(1, "a", at(0)), (2, "a", at(4))], [(3, "a", at(1)), (4, "b", at(5))]):  # the second file reopens a bin
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = st.read_checkin_stream(spark, src, schema, max_files_per_trigger=1)
    st.upsert_stream_to_table(st.streaming_cell_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r["t"].hour, r["region"]): r["obs_freq"] for r in st.latest_bins(spark, str(tmp_path / "out")).collect()}
    assert got == {(0, "a"): 2, (3, "a"): 1, (3, "b"): 1}
