"""Region polygons and the distributed point-in-polygon join.

Filter-and-refine without a spatial library:

* index (small, polygon side): every polygon is covered by square grid cells of side
  ``cell``.  A cell that no edge comes near lies wholly inside, and is marked so and keeps no
  edges, or wholly outside, and is dropped.  The others, along the outline, keep the
  polygon's bounding box and those edges of the cell's horizontal band that do not lie to the
  left of the cell (a ray cast to the right can only cross those);
* join (event side): each point computes its cell id and equi-joins the index, so the
  join is a hash join with no nested loop and no cross product;
* refine: bounding-box test, boundary test, and even-odd crossing count evaluated as
  native higher-order functions over the band edges, with exact cross products (no
  division).  Points on an edge are outside (strict interior).  With overlapping
  polygons the lowest ``region_id`` wins.

The index is broadcast only after its measured size is below ``broadcast_limit_bytes``;
otherwise both sides are shuffled on the cell id (AQE splits hot cells).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "Other"


# ---------------------------------------------------------------- region table ops

def filter_regions(regions: DataFrame, city: str | None = None, exclude_counties: Sequence[str] = ()) -> DataFrame:
    """PF1 + PF2: keep one city, drop listed counties."""
    df = regions
    if city is not None:
        df = df.filter(F.col("city") == city)
    if exclude_counties:
        df = df.filter(~F.col("county").isin(list(exclude_counties)))
    return df


def duplicate_regions(regions: DataFrame, name_col: str = "name") -> DataFrame:
    """AG13: names that occur more than once: (name, n)."""
    return regions.groupBy(name_col).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def apply_region_corrections(regions: DataFrame, corrections: Iterable[tuple] | DataFrame) -> DataFrame:
    """PF3: keyed corrections ``(name, county, action, new_name)`` with action 'drop' or
    'rename' (instead of hard-coded row positions).  A list of corrections is a parameter
    that the driver holds anyway, and is broadcast; a DataFrame of them may be of any size,
    and Spark chooses the join."""
    spark = regions.sparkSession
    if not isinstance(corrections, DataFrame):
        corrections = F.broadcast(spark.createDataFrame(
            list(corrections), "c_name STRING, c_county STRING, action STRING, new_name STRING"
        ))
    else:
        corrections = corrections.toDF("c_name", "c_county", "action", "new_name")
    j = regions.join(
        corrections,
        (regions["name"] == corrections["c_name"]) & (regions["county"].eqNullSafe(corrections["c_county"])),
        "left",
    )
    j = j.filter(F.col("action").isNull() | (F.col("action") != "drop"))
    j = j.withColumn("name", F.when(F.col("action") == "rename", F.col("new_name")).otherwise(F.col("name")))
    return j.select(*regions.columns)


def region_names(regions: DataFrame) -> DataFrame:
    """JN2 lookup table: (region_id, name)."""
    return regions.select("region_id", "name")


# ---------------------------------------------------------------- polygon index

def polygon_edges(regions: DataFrame) -> DataFrame:
    """(region_id, x1, y1, x2, y2) for every ring edge, rings closed implicitly."""
    rings = regions.select("region_id", F.explode("rings").alias("ring"))
    n = F.size("ring")
    edges = rings.select(
        "region_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.struct(
                    F.col("ring")[i]["lon"].alias("x1"),
                    F.col("ring")[i]["lat"].alias("y1"),
                    F.col("ring")[(i + 1) % n]["lon"].alias("x2"),
                    F.col("ring")[(i + 1) % n]["lat"].alias("y2"),
                ),
            )
        ).alias("e"),
    )
    return edges.select("region_id", "e.*")


def polygon_index(regions: DataFrame, cell: float) -> DataFrame:
    """(cx, cy, candidates array<struct<region_id, name, minx, miny, maxx, maxy, edges, interior>>)."""
    edges = polygon_edges(regions)
    box = edges.groupBy("region_id").agg(
        F.least(F.min("x1"), F.min("x2")).alias("minx"),
        F.greatest(F.max("x1"), F.max("x2")).alias("maxx"),
        F.least(F.min("y1"), F.min("y2")).alias("miny"),
        F.greatest(F.max("y1"), F.max("y2")).alias("maxy"),
    )
    c = F.lit(float(cell))
    cells = box.select(
        "*",
        F.explode(F.sequence(F.floor(F.col("minx") / c), F.floor(F.col("maxx") / c))).alias("cx"),
    ).select(
        "*",
        F.explode(F.sequence(F.floor(F.col("miny") / c), F.floor(F.col("maxy") / c))).alias("cy"),
    )
    band_edges = edges.select(
        "region_id",
        F.struct("x1", "y1", "x2", "y2").alias("edge"),
        F.explode(
            F.sequence(F.floor(F.least("y1", "y2") / c), F.floor(F.greatest("y1", "y2") / c))
        ).alias("cy"),
    ).groupBy("region_id", "cy").agg(F.collect_list("edge").alias("edges"))
    names = regions.select("region_id", "name")
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    held = cells.join(band_edges, ["region_id", "cy"], "left").withColumn("edges", F.coalesce("edges", none))
    # the cell's box, a little wider than rounding can move a point
    left, right, low, high = (F.col(k) * c + side * c * 1e-6 + (c if side > 0 else 0) for k, side in (("cx", -1), ("cx", 1), ("cy", -1), ("cy", 1)))
    near = F.exists("edges", lambda e: (F.least(e["x1"], e["x2"]) <= right) & (F.greatest(e["x1"], e["x2"]) >= left)
                    & (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["y1"], e["y2"]) >= low))
    middle = _inside((F.col("cx") + 0.5) * c, (F.col("cy") + 0.5) * c)(F.struct("minx", "miny", "maxx", "maxy", "edges", F.lit(False).alias("interior")))
    held = held.withColumn("near", near).withColumn("interior", ~F.col("near") & middle).filter("near or interior")
    held = held.withColumn("edges", F.when(F.col("interior"), none).otherwise(F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= left)))
    cand = held.join(names, "region_id", "left").select("cx", "cy", F.struct("region_id", "name", "minx", "miny", "maxx", "maxy", "edges", "interior").alias("c"))
    return cand.groupBy("cx", "cy").agg(F.array_sort(F.collect_list("c")).alias("candidates"))


def _inside(px: Column, py: Column):
    def d(e):
        return (e["x2"] - e["x1"]) * (py - e["y1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])

    def crosses(e):
        return ((e["y1"] > py) != (e["y2"] > py)) & ((d(e) > 0) == (e["y2"] > e["y1"]))

    def on_edge(e):
        return (
            (d(e) == 0)
            & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    def inside(c):
        in_box = px.between(c["minx"], c["maxx"]) & py.between(c["miny"], c["maxy"])
        n_cross = F.aggregate(c["edges"], F.lit(0), lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0))
        return c["interior"] | (in_box & ~F.exists(c["edges"], on_edge) & ((n_cross % 2) == 1))

    return inside


def _estimated_bytes(index: DataFrame) -> int:
    row = index.agg(
        F.count(F.lit(1)).alias("cells"),
        F.coalesce(F.sum(F.size("candidates")), F.lit(0)).alias("cands"),
        F.coalesce(
            F.sum(F.aggregate("candidates", F.lit(0), lambda a, c: a + F.size(c["edges"]))), F.lit(0)
        ).alias("edges"),
    ).first()
    return int(row["cells"]) * 32 + int(row["cands"]) * 64 + int(row["edges"]) * 40


def assign_region(
    points: DataFrame,
    regions: DataFrame,
    cell: float = 0.01,
    lon_col: str = "lon",
    lat_col: str = "lat",
    keep_other: bool = False,
    broadcast_limit_bytes: int = 64 << 20,
) -> DataFrame:
    """JN1 + JN2 + PF5 + PF12: attach ``region_id`` and ``region`` (name) to each point.

    Points outside every polygon are dropped, or kept with region 'Other' when
    ``keep_other``.
    """
    # built once (several shuffles over the polygon table), then size-checked and joined
    from regionpulse.session import materialize

    index = materialize(polygon_index(regions, cell), "polygon-index")
    if _estimated_bytes(index) <= broadcast_limit_bytes:
        index = F.broadcast(index)
    c = F.lit(float(cell))
    px, py = F.col(lon_col), F.col(lat_col)
    pts = points.withColumn("_cx", F.floor(px / c)).withColumn("_cy", F.floor(py / c))
    how = "left" if keep_other else "inner"
    j = pts.join(index, (pts["_cx"] == index["cx"]) & (pts["_cy"] == index["cy"]), how)
    inside = _inside(px, py)
    # smallest (region_id, name) among the polygons that strictly contain the point
    hit = F.array_min(
        F.transform(F.filter(F.col("candidates"), inside), lambda c: F.struct(c["region_id"].alias("id"), c["name"].alias("name")))
    )
    out = (
        j.withColumn("_hit", hit)
        .withColumn("region_id", F.col("_hit.id"))
        .withColumn("region", F.coalesce(F.col("_hit.name"), F.lit(OTHER)))
        .drop("_cx", "_cy", "cx", "cy", "candidates", "_hit")
    )
    if not keep_other:
        out = out.filter(F.col("region_id").isNotNull())
    return out
