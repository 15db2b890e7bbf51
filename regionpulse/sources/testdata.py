"""Adapters that map the generated test tables onto the pipeline's input schemas.

events   -> check-ins (event_type <> 'error') and incidents (error with value > 50);
            venue = k of the JSON props, region = 'r' || k % 10, category = k % 7
lineitem -> check-ins with 25 regions: user = o_custkey, venue = l_suppkey,
            region = the supplier's nation name, time = l_shipdate; incident = returnflag 'R'
embeddings -> points: the first two vector components
nation   -> polygons: one shape per nation, laid out on a 5 x 5 grid by a fixed rule
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _venue() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


def event_checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, venue_id, region, ts, seq) from the events stream."""
    return checkins_of_events(table(spark, sf_dir, "events"))


def checkins_of_events(events: DataFrame) -> DataFrame:
    """The check-in rule on an events DataFrame (batch or streaming)."""
    k = _venue()
    return (
        events
        .filter(F.col("event_type") != "error")
        .select(
            "user_id",
            k.alias("venue_id"),
            F.concat(F.lit("r"), (k % 10).cast("string")).alias("region"),
            "ts",
            F.col("event_id").alias("seq"),
        )
    )


def event_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(incident_id, ts, region, offense) from the events stream."""
    k = _venue()
    return (
        table(spark, sf_dir, "events")
        .filter((F.col("event_type") == "error") & (F.col("value") > 50))
        .select(
            F.col("event_id").alias("incident_id"),
            "ts",
            F.concat(F.lit("r"), (k % 10).cast("string")).alias("region"),
            F.col("event_type").alias("offense"),
        )
    )


def event_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct venues seen in check-ins with their region and category (k % 7)."""
    return (
        event_checkins(spark, sf_dir)
        .select("venue_id", "region", (F.col("venue_id") % 7).alias("category"))
        .distinct()
    )


def region_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, area, population) for the event regions: area = 1 + i, population = 1000 (1 + i)."""
    i = (F.get_json_object("props", "$.k").cast("long") % 10)
    return (
        table(spark, sf_dir, "events")
        .select(
            F.concat(F.lit("r"), i.cast("string")).alias("region"),
            (F.lit(1.0) + i).alias("area"),
            (F.lit(1000) * (i + 1)).alias("population"),
        )
        .filter(F.col("region").isNotNull())
        .distinct()
    )


def lineitem_checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, venue_id, region, ts, seq, incident) from lineitem x orders x supplier x nation."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # nation has a fixed 25 rows: a proven size bound, safe to broadcast
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(s, li.l_suppkey == s.s_suppkey)
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_suppkey").alias("venue_id"),
            F.col("n_name").alias("region"),
            F.col("l_shipdate").alias("ts"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
            (F.col("l_returnflag") == "R").alias("incident"),
        )
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, lon, lat) = (vec_id, embedding[0], embedding[1])."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("point_id"),
        F.col("embedding")[0].cast("double").alias("lon"),
        F.col("embedding")[1].cast("double").alias("lat"),
    )


# Fixed shape templates in unit-cell coordinates: (shape, ring, vertex, u, v).
# shape 0 square, 1 concave "L", 2 square with a square hole, 3 square that
# overlaps its neighbours.
SHAPE_TEMPLATES = [
    (0, 0, 0, 0.1, 0.1), (0, 0, 1, 0.9, 0.1), (0, 0, 2, 0.9, 0.9), (0, 0, 3, 0.1, 0.9),
    (1, 0, 0, 0.1, 0.1), (1, 0, 1, 0.9, 0.1), (1, 0, 2, 0.9, 0.4), (1, 0, 3, 0.4, 0.4), (1, 0, 4, 0.4, 0.9), (1, 0, 5, 0.1, 0.9),
    (2, 0, 0, 0.1, 0.1), (2, 0, 1, 0.9, 0.1), (2, 0, 2, 0.9, 0.9), (2, 0, 3, 0.1, 0.9),
    (2, 1, 0, 0.3, 0.3), (2, 1, 1, 0.7, 0.3), (2, 1, 2, 0.7, 0.7), (2, 1, 3, 0.3, 0.7),
    (3, 0, 0, -0.3, -0.3), (3, 0, 1, 1.3, -0.3), (3, 0, 2, 1.3, 1.3), (3, 0, 3, -0.3, 1.3),
]
CELL = 0.2
ORIGIN = -0.5


def nation_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, name, county, city, rings): nation n is shape n % 4 in grid cell (n % 5, n / 5)."""
    tpl = spark.createDataFrame(SHAPE_TEMPLATES, "shape INT, ring INT, vertex INT, u DOUBLE, v DOUBLE")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    verts = nat.join(F.broadcast(tpl), (F.col("n_nationkey") % 4) == F.col("shape")).select(
        F.col("n_nationkey").cast("long").alias("region_id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("string").alias("county"),
        F.lit("World").alias("city"),
        "ring",
        "vertex",
        (F.lit(ORIGIN) + (F.col("n_nationkey") % 5).cast("double") * CELL + F.col("u") * CELL).alias("lon"),
        (F.lit(ORIGIN) + F.floor(F.col("n_nationkey") / 5).cast("double") * CELL + F.col("v") * CELL).alias("lat"),
    )
    rings = verts.groupBy("region_id", "name", "county", "city", "ring").agg(
        F.array_sort(F.collect_list(F.struct("vertex", "lon", "lat"))).alias("vs")
    )
    rings = rings.select(
        "region_id", "name", "county", "city", "ring",
        F.transform("vs", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("ring_pts"),
    )
    return rings.groupBy("region_id", "name", "county", "city").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ring", "ring_pts"))), lambda r: r["ring_pts"]).alias("rings")
    )
