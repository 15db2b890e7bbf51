"""Time grid: tumbling bins, the gap-free interval spine, densification, low-activity cut, pivot.

The dense interval x region grid is produced by a Generate (``explode(sequence(lo, hi))``)
per region, with lo/hi as lazy scalar subqueries: no cross join and no driver round trip.
Its size is the size of the requested output (T x R), never the size of the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from regionpulse.functions import interval_expr, time_bin


def add_bin(df: DataFrame, ts_col: str = "ts", interval: str = "3 hours", out: str = "t") -> DataFrame:
    """TM1: attach the tumbling-bin start of ``ts_col``."""
    return df.withColumn(out, time_bin(ts_col, interval))


def _bounds(binned: DataFrame, t_col: str = "t") -> tuple[Column, Column]:
    b = binned.agg(F.min(t_col).alias("lo"), F.max(t_col).alias("hi"))
    return b.select("lo").scalar(), b.select("hi").scalar()


def spine_of(binned: DataFrame, interval: str = "3 hours", t_col: str = "t") -> DataFrame:
    """All bins from the first to the last occupied one, gaps included: (t)."""
    lo, hi = _bounds(binned, t_col)
    one = binned.sparkSession.range(1)
    return one.select(F.explode(F.sequence(lo, hi, interval_expr(interval))).alias(t_col))


def interval_spine(events: DataFrame, ts_col: str = "ts", interval: str = "3 hours", count_col: str | None = "user_id") -> DataFrame:
    """AG1: rows per bin over the full spine, empty bins with 0: (t, n).

    ``count_col`` counts non-null values of that column (the reference counts user ids);
    None counts rows.
    """
    binned = add_bin(events.filter(F.col(ts_col).isNotNull()), ts_col, interval)
    agg = F.count(count_col) if count_col else F.count(F.lit(1))
    counts = binned.groupBy("t").agg(agg.alias("n"))
    spine = spine_of(binned, interval)
    return spine.join(counts, "t", "left").select("t", F.coalesce("n", F.lit(0)).alias("n"))


def grid_of(regions: DataFrame, binned: DataFrame, interval: str = "3 hours", region_col: str = "region") -> DataFrame:
    """JN3 grid: every (t, region) of spine x regions, generated per region row."""
    lo, hi = _bounds(binned)
    return regions.select(region_col).distinct().select(
        F.explode(F.sequence(lo, hi, interval_expr(interval))).alias("t"), region_col
    )


def densify_grid(
    cells: DataFrame,
    grid: DataFrame,
    value_cols: Sequence[str],
    keys: Sequence[str] = ("t", "region"),
    fill=0,
) -> DataFrame:
    """JN3 / PF15: left-join sparse cells onto the grid and fill missing values."""
    joined = grid.join(cells, list(keys), "left")
    return joined.select(*keys, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in value_cols])


def low_activity_filter(
    matrix: DataFrame,
    obs: DataFrame | None = None,
    min_interval_obs: int = 20,
    min_region_obs: int = 300,
    obs_col: str = "obs_freq",
) -> DataFrame:
    """JN9 / AG11: drop intervals with total obs < min_interval_obs and regions with
    total obs < min_region_obs.  Both totals come from the unfiltered ``obs`` table
    (defaults to ``matrix``), so the order of the two cuts does not matter.
    """
    obs = matrix if obs is None else obs
    keep_t = obs.groupBy("t").agg(F.sum(obs_col).alias("_s")).filter(F.col("_s") >= min_interval_obs).select("t")
    keep_r = obs.groupBy("region").agg(F.sum(obs_col).alias("_s")).filter(F.col("_s") >= min_region_obs).select("region")
    return matrix.join(keep_t, "t", "left_semi").join(keep_r, "region", "left_semi")


def feature_pivot(
    long: DataFrame, regions: Sequence[str], value_col: str, index: str = "t", agg: str = "first", fill=None
) -> DataFrame:
    """AG14: long -> wide by region, with an explicit value list (no discovery pass).

    ``fill`` replaces absent cells (the reference fills them with 0 before use).
    """
    wide = long.groupBy(index).pivot("region", list(regions)).agg(getattr(F, agg)(value_col))
    if fill is not None:
        wide = wide.select(index, *[F.coalesce(F.col(r), F.lit(fill)).alias(r) for r in regions])
    return wide


def region_list(df: DataFrame, region_col: str = "region", most: int = 10_000) -> list[str]:
    """The distinct region names, sorted, for operators that make a column per region; more
    than ``most`` columns are refused."""
    names = [r[0] for r in df.select(region_col).filter(F.col(region_col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} regions: too many for a column each")
    return sorted(names)


def region_one_hot(df: DataFrame, regions: Sequence[str], region_col: str = "region", prefix: str = "") -> DataFrame:
    """PF13: one 0/1 integer column per listed region, no pivot pass."""
    return df.select(
        "*", *[F.when(F.col(region_col) == r, 1).otherwise(0).alias(f"{prefix}{r}") for r in regions]
    )


def dense_ids(keys: DataFrame, key_cols: Sequence[str], out: str) -> DataFrame:
    """0-based dense ids over DISTINCT keys (the interval list or the feature-column list).

    The window has no partition on purpose: its input is the small distinct key
    list (T or 5R rows), never event-sized data.
    """
    d = keys.select(*key_cols).distinct()
    return d.withColumn(out, F.dense_rank().over(Window.orderBy(*key_cols)) - 1)
