"""File sources and sinks.

* check-ins and incidents come as CSV with an explicit schema (no inference);
* polygons come as a table of GeoJSON or WKT geometry text, parsed with native
  string/JSON expressions into ``rings array<array<struct<lon,lat>>>``;
* intermediate tables go to parquet, optionally partitioned by a date column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# venue ids are opaque text
CHECKIN_SCHEMA = "user_id BIGINT, venue_id STRING, region STRING, ts TIMESTAMP_NTZ, seq BIGINT, longitude DOUBLE, latitude DOUBLE"
# Incidents are read as text and parsed leniently afterwards (bad rows -> NULL).
INCIDENT_SCHEMA = "incident_id BIGINT, date_text STRING, time_text STRING, offense STRING, region STRING, longitude DOUBLE, latitude DOUBLE"

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV sink with a header and the same timestamp text the readers expect."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )
    return path


def read_csv_by_header(spark: SparkSession, path: str | Sequence[str], schema: str, on_bad: str = "fail") -> DataFrame:
    """CSV with a header, columns bound by name and cast to ``schema``.

    The order of the file's columns does not matter and unknown ones are left out; a missing
    one is an error.  Text that is not of its column's type raises (``on_bad="fail"``) or
    becomes NULL (``"null"``); nothing is nulled silently."""
    raw = spark.read.option("header", True).csv(path)
    wanted = T._parse_datatype_string(schema)
    if lost := [f.name for f in wanted if f.name not in raw.columns]:
        raise ValueError(f"columns {lost} are not in the header {raw.columns}")

    def typed(f: T.StructField) -> Column:
        text = F.col(f"`{f.name}`")
        value = text if isinstance(f.dataType, T.StringType) else F.trim(text).try_cast(f.dataType)
        if on_bad == "fail" and not isinstance(f.dataType, T.StringType):
            said = F.concat(F.lit(f"{f.name}: not {f.dataType.simpleString()}: "), text)
            value = F.when(text.isNotNull() & value.isNull(), F.raise_error(said).cast(f.dataType)).otherwise(value)
        return value.alias(f.name)

    return raw.select(*[typed(f) for f in wanted])


def load_checkins(spark: SparkSession, path: str | Sequence[str], schema: str = CHECKIN_SCHEMA, on_bad: str = "fail") -> DataFrame:
    """IO1 + PF4: check-in CSV with a parsed timestamp (no session zone involved) and, when
    it has coordinates, a (lon, lat) point column."""
    df = read_csv_by_header(spark, path, schema, on_bad)
    if "longitude" in df.columns and "latitude" in df.columns:
        df = df.withColumn("point", F.struct(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")))
    return df


def load_incidents(spark: SparkSession, path: str | Sequence[str], schema: str = INCIDENT_SCHEMA, on_bad: str = "fail") -> DataFrame:
    """IO2: incident CSV, all text for the date/time columns (parsed by ``parse_incident_time``)."""
    return read_csv_by_header(spark, path, schema, on_bad)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> str:
    """IO4/IO5 sink: parquet, partitioned by (low-cardinality) columns when given."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.parquet(path)


def load_model_table(spark: SparkSession, path: str, label_col: str = "crime") -> DataFrame:
    """IO6: a saved model table; every column except the label is a feature.

    Returns ``features`` (ML vector) and ``label`` (double).
    """
    from pyspark.ml.feature import VectorAssembler

    df = spark.read.parquet(path)
    feats = [c for c in df.columns if c != label_col]
    asm = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    return asm.transform(df.withColumn("label", F.col(label_col).cast("double"))).select("features", "label", *feats)


# --------------------------------------------------------------------------- polygons

_POLYGON = "coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>"
_MULTI = "coordinates ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"


def _unknown(text: Column, kind: str) -> Column:
    said = F.concat(F.lit(f"not a {kind} polygon or multi-polygon: "), F.substring(text, 1, 80))
    return F.raise_error(said).cast(RINGS)


def geojson_rings(text: Column) -> Column:
    """``Polygon`` or ``MultiPolygon`` geometry text -> rings of (lon, lat) structs, the rings of
    all parts in one list (a point is inside when it crosses an odd number of edges); a null
    geometry stays null, any other type is an error."""
    kind = F.get_json_object(text, "$.type")
    rings = F.when(kind == "MultiPolygon", F.flatten(F.from_json(text, _MULTI)["coordinates"])).otherwise(F.from_json(text, _POLYGON)["coordinates"])
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return F.when(text.isNull(), F.lit(None).cast(RINGS)).when(kind.isin("Polygon", "MultiPolygon") & points.isNotNull(), points).otherwise(_unknown(text, "GeoJSON"))


def wkt_rings(text: Column) -> Column:
    """``POLYGON ((x y, ...), ...)`` or ``MULTIPOLYGON (((x y, ...), ...), ...)`` text -> rings of
    (lon, lat) structs, as for GeoJSON."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?i)(MULTI)?POLYGON[\s(]*", ""), r"[)\s]*$", "")
    points = F.transform(
        F.split(body, r"\)[\s)]*,[\s(]*\("),
        lambda ring: F.transform(
            F.split(F.trim(ring), r"\s*,\s*"),
            lambda p: F.struct(
                F.split(F.trim(p), r"\s+")[0].cast("double").alias("lon"),
                F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat"),
            ),
        ),
    )
    return F.when(text.isNull(), F.lit(None).cast(RINGS)).when(F.trim(text).rlike(r"^(?i)(MULTI)?POLYGON\s*\("), points).otherwise(_unknown(text, "WKT"))


def load_regions(
    spark: SparkSession,
    path_or_df,
    fmt: str = "parquet",
    geometry_col: str = "geometry",
    encoding: str = "geojson",
) -> DataFrame:
    """IO3: polygon table -> (region_id, name, county, city, rings).

    ``path_or_df`` is a DataFrame or a path read with ``fmt``; the geometry column
    holds GeoJSON (default) or WKT text.  ``region_id`` is taken from the input
    when present, else it is the 0-based position by name (the polygon table is
    small: one row per named region).
    """
    df = path_or_df if isinstance(path_or_df, DataFrame) else spark.read.format(fmt).option("header", True).load(path_or_df)
    parse = geojson_rings if encoding == "geojson" else wkt_rings
    out = df.withColumn("rings", parse(F.col(geometry_col)))
    lower = {c.lower(): c for c in out.columns}
    for want in ("name", "county", "city"):
        if want not in out.columns and want in lower:
            out = out.withColumnRenamed(lower[want], want)
    for want in ("name", "county", "city"):
        if want not in out.columns:
            out = out.withColumn(want, F.lit(None).cast("string"))
    if "region_id" not in out.columns:
        from pyspark.sql import Window

        out = out.withColumn("region_id", F.row_number().over(Window.orderBy("name", "county")) - 1)
    return out.select(F.col("region_id").cast("long"), "name", "county", "city", "rings")
