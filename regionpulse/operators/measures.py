"""Density, diversity and similarity measures per region (DataFrame versions of the
reference's measure helpers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from regionpulse.functions import dot, entropy_term, l2_norm, ratio


def daily_counts(events: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Events per (region, calendar day): (region, day, n)."""
    d = events.select("region", F.to_date(F.col(ts_col)).alias("day"))
    d = d.filter(F.col("region").isNotNull() & F.col("day").isNotNull())
    return d.groupBy("region", "day").agg(F.count(F.lit(1)).alias("n"))


def _trailing(daily: DataFrame, days: int) -> DataFrame:
    # window over the per-day series of one region: at most one row per day
    w = Window.partitionBy("region").orderBy("day_no").rangeBetween(-(days - 1), 0)
    d = daily.withColumn("day_no", F.unix_date("day"))
    return d.withColumn("n_window", F.sum("n").over(w)).drop("day_no")


def area_incident_density(events: DataFrame, attributes: DataFrame, days: int = 7, ts_col: str = "ts") -> DataFrame:
    """AG16: events over the trailing ``days`` days divided by region area:
    (region, day, n_window, area_incident_density)."""
    t = _trailing(daily_counts(events, ts_col), days)
    j = t.join(attributes.select("region", "area"), "region")
    return j.select("region", "day", "n_window", ratio("n_window", "area").alias("area_incident_density"))


def population_incident_density(events: DataFrame, attributes: DataFrame, days: int = 7, ts_col: str = "ts") -> DataFrame:
    """AG17: same, divided by population."""
    t = _trailing(daily_counts(events, ts_col), days)
    j = t.join(attributes.select("region", "population"), "region")
    return j.select("region", "day", "n_window", ratio("n_window", "population").alias("population_incident_density"))


def venue_category_counts(venues: DataFrame) -> DataFrame:
    """Distinct venues per (region, category)."""
    return venues.groupBy("region", "category").agg(F.count_distinct("venue_id").alias("n_venues"))


def venue_category_share(venues: DataFrame) -> DataFrame:
    """AG18: share of a region's venues in each category."""
    c = venue_category_counts(venues)
    w = Window.partitionBy("region")  # at most (#categories) rows per region
    return c.withColumn("share", ratio(F.col("n_venues"), F.sum("n_venues").over(w)))


def venue_category_density(venues: DataFrame, attributes: DataFrame) -> DataFrame:
    """AG19: venues of a category per unit area."""
    c = venue_category_counts(venues).join(attributes.select("region", "area"), "region")
    return c.select("region", "category", "n_venues", ratio("n_venues", "area").alias("density"))


def regional_diversity(shares: DataFrame, share_col: str = "share") -> DataFrame:
    """AG20: Shannon entropy (natural log) of the category shares; 0 ln 0 := 0."""
    s = shares.filter(F.col(share_col) > 0)
    return s.groupBy("region").agg(F.sum(entropy_term(share_col, base="e")).alias("diversity"))


def share_of_total(df: DataFrame, value_col: str, by: str | None = None, out: str = "share") -> DataFrame:
    """AG21: x / sum(x), over the whole column or within ``by`` groups."""
    if by:
        return df.withColumn(out, ratio(F.col(value_col), F.sum(value_col).over(Window.partitionBy(by))))
    # grand total as a scalar subquery: no single-partition window over the rows
    total = df.agg(F.sum(value_col).alias("_total")).select("_total").scalar()
    return df.withColumn(out, ratio(F.col(value_col), total))


def visitor_count_overall(checkins: DataFrame) -> DataFrame:
    """AG22: distinct users per region over all time (NULL users are not counted)."""
    return checkins.filter(F.col("region").isNotNull()).groupBy("region").agg(
        F.count_distinct("user_id").alias("visitor_count")
    )


def region_cosine(long: DataFrame, pairs: DataFrame, key: str = "t", value_col: str = "value") -> DataFrame:
    """AG23: cosine of region vectors stored sparsely as (key, region, value) rows, for
    the requested (region_a, region_b) pairs only; zero norm -> NULL.

    The dot product joins the two regions' entries on the key, so work is linear in
    the entries of the requested pairs; all-pairs products are never formed.
    """
    v = long.select(key, "region", F.col(value_col).cast("double").alias("v"))
    norms = v.groupBy("region").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    a = pairs.join(v.withColumnRenamed("region", "region_a").withColumnRenamed("v", "va"), "region_a")
    ab = a.join(
        v.withColumnRenamed("region", "region_b").withColumnRenamed("v", "vb"), ["region_b", key]
    )
    dots = ab.groupBy("region_a", "region_b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    out = pairs.join(dots, ["region_a", "region_b"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))
    na = norms.withColumnRenamed("region", "region_a").withColumnRenamed("norm", "norm_a")
    nb = norms.withColumnRenamed("region", "region_b").withColumnRenamed("norm", "norm_b")
    out = out.join(na, "region_a", "left").join(nb, "region_b", "left")
    return out.select(
        "region_a", "region_b",
        F.try_divide(F.col("dot"), F.nullif(F.col("norm_a") * F.col("norm_b"), F.lit(0.0))).alias("cosine"),
    )


def vector_cosine(left: DataFrame, right: DataFrame, on: str | list[str], vec_col: str = "embedding") -> DataFrame:
    """AG23 on dense array columns: cosine of ``left.vec`` and ``right.vec`` for rows
    matched by an equi-join on ``on``; zero norm -> NULL."""
    lv = left.withColumnRenamed(vec_col, "_u")
    rv = right.withColumnRenamed(vec_col, "_v")
    j = lv.join(rv, on)
    den = F.nullif(l2_norm("_u") * l2_norm("_v"), F.lit(0.0))
    return j.withColumn("cosine", F.try_divide(dot("_u", "_v"), den)).drop("_u", "_v")
