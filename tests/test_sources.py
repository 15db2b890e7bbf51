"""Readers: polygon text (WKT and GeoJSON), check-in CSV with coordinates."""

import datetime as dt
import os

import pytest

from regionpulse import sources as src
from regionpulse.operators import geo


def test_wkt_and_geojson_polygons_agree(spark):
    wkt = "POLYGON ((5 0, 8 0, 8 3, 5 3), (6 1, 7 1, 7 2, 6 2))"
    gj = '{"type": "Polygon", "coordinates": [[[5, 0], [8, 0], [8, 3], [5, 3]], [[6, 1], [7, 1], [7, 2], [6, 2]]]}'
    a = src.load_regions(spark, spark.createDataFrame([(0, "holed", "c", "x", wkt)], "region_id INT, Name STRING, County STRING, City STRING, geometry STRING"), encoding="wkt")
    b = src.load_regions(spark, spark.createDataFrame([(0, "holed", "c", "x", gj)], "region_id INT, Name STRING, County STRING, City STRING, geometry STRING"))
    ra, rb = a.first(), b.first()
    assert ra["rings"] == rb["rings"] and len(ra["rings"]) == 2 and ra["name"] == "holed"
    pts = spark.createDataFrame([(0, 5.5, 0.5), (1, 6.5, 1.5)], "point_id BIGINT, lon DOUBLE, lat DOUBLE")
    assert [r["point_id"] for r in geo.assign_region(pts, a, cell=1.0).collect()] == [0]


def test_region_ids_assigned_by_name_when_absent(spark):
    gj = '{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}'
    df = spark.createDataFrame([("b", gj), ("a", gj)], "name STRING, geometry STRING")
    got = {r["name"]: r["region_id"] for r in src.load_regions(spark, df).collect()}
    assert got == {"a": 0, "b": 1}


def test_checkin_csv_roundtrip_with_point(spark, tmp_path):
    rows = [(1, "49bbd6c0f964a520f4531fe3", "a", dt.datetime(2012, 4, 3, 18, 0, 9, 123456), 0, -73.9, 40.7)]
    df = spark.createDataFrame(rows, src.CHECKIN_SCHEMA)
    path = str(tmp_path / "ck")
    src.write_csv(df, path)
    back = src.load_checkins(spark, path).first()
    assert back["venue_id"] == rows[0][1] and back["ts"] == rows[0][3] and back["point"]["lon"] == -73.9 and back["point"]["lat"] == 40.7


def test_csv_columns_are_bound_by_name_and_bad_text_is_not_silent(spark, tmp_path):
    path = tmp_path / "swapped.csv"
    path.write_text("venue_id,user_id,extra\nx1,7,a\nx2,seven,b\n")
    schema = "user_id BIGINT, venue_id STRING"
    got = src.load_checkins(spark, str(path), schema, on_bad="null").collect()
    assert [(r["user_id"], r["venue_id"]) for r in got] == [(7, "x1"), (None, "x2")]
    with pytest.raises(Exception, match="user_id: not bigint: seven"):
        src.load_checkins(spark, str(path), schema).collect()
    with pytest.raises(ValueError, match="ts"):
        src.load_checkins(spark, str(path), schema + ", ts TIMESTAMP_NTZ")


def test_multi_part_regions(spark):
    gj = '{"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 1]]], [[[5, 0], [8, 0], [8, 3], [5, 3]], [[6, 1], [7, 1], [7, 2], [6, 2]]]]}'
    wkt = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1)), ((5 0, 8 0, 8 3, 5 3), (6 1, 7 1, 7 2, 6 2)))"
    pts = spark.createDataFrame([(0, 5.5, 0.5), (1, 6.5, 1.5), (2, 0.5, 0.5), (3, 3.0, 0.5)], "point_id BIGINT, lon DOUBLE, lat DOUBLE")
    for text, encoding in ((gj, "geojson"), (wkt, "wkt")):
        regions = src.load_regions(spark, spark.createDataFrame([(0, "parts", text)], "region_id INT, name STRING, geometry STRING"), encoding=encoding)
        assert len(regions.first()["rings"]) == 3
        assert sorted(r["point_id"] for r in geo.assign_region(pts, regions, cell=1.0).collect()) == [0, 2]
    for text, encoding in (('{"type": "Point", "coordinates": [1, 2]}', "geojson"), ("POINT (1 2)", "wkt")):
        with pytest.raises(Exception, match="polygon or multi-polygon"):
            src.load_regions(spark, spark.createDataFrame([(0, "p", text)], "region_id INT, name STRING, geometry STRING"), encoding=encoding).collect()


def test_hour_that_the_session_zone_skips(spark):
    from regionpulse.operators import clean

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("03/11/2012", "02:30:00")], "date_text STRING, time_text STRING")
        assert clean.parse_incident_time(df).first()["ts"] == dt.datetime(2012, 3, 11, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from regionpulse import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]")


def test_scopes_of_two_threads_do_not_mix(spark):
    """A scope that ends in one thread leaves the tables of another thread's scope alone."""
    import threading

    from regionpulse.session import materialize, scratch

    inner, ended, got = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            table = materialize(spark.range(5), "theirs")
            inner.set()
            ended.wait(60)
            got.append(table.inputFiles())
            got.append(table.count())

    thread = threading.Thread(target=other)
    with scratch(spark):
        mine = materialize(spark.range(3), "mine").inputFiles()
        thread.start()
        assert inner.wait(60)
    ended.set()
    thread.join(60)
    assert got[1:] == [5]
    assert not any(os.path.exists(f.removeprefix("file://")) for f in mine + got[0])
