"""The five dynamic region features on (t, region) cells.

Input contract (check-ins): ``user_id, venue_id, region, ts`` and optionally ``seq``
(file order, the tie-break for "first visit").  Rows with a NULL bin or NULL region
are dropped up front (group keys that are NULL are dropped by the reference).

Shuffle plan for ``feature_matrix`` (E = check-in rows):
  1. E -> partial hash agg -> exchange (t, region, user, venue), written once
  2. from it: (t, region, user) visits, (user, venue) counts and first-visit keys
  3. cell x user  join  user totals on user                [AQE: broadcast or skew-split]
  4. top-k per user: partial WindowGroupLimit before the exchange on user
  5. small aggregates to (t, region) and the generated grid, joined on (t, region)
Nothing is collected; the only window over event-derived data is partitioned by user
and fed at most k rows per user per map partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from regionpulse.config import FEATURES, PipelineConfig
from regionpulse.functions import entropy_term, no_negative_zero, ntz_from_epoch_micros, ntz_epoch_micros, ratio, time_bin
from regionpulse.operators.grid import densify_grid, grid_of
from regionpulse.session import materialize as write_once

DEFAULT = PipelineConfig()


def binned_checkins(checkins: DataFrame, interval: str = "3 hours") -> DataFrame:
    """Check-ins with their bin ``t``; rows without time or region are dropped."""
    df = checkins.withColumn("t", time_bin("ts", interval))
    return df.filter(F.col("t").isNotNull() & F.col("region").isNotNull())


# ----------------------------------------------------------------- per-cell counts

def obs_freq(binned: DataFrame) -> DataFrame:
    """AG3: check-ins with a user per (t, region): (t, region, obs_freq)."""
    return binned.groupBy("t", "region").agg(F.count("user_id").alias("obs_freq"))


def visitor_count(binned: DataFrame, approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """AG2: distinct users per (t, region): (t, region, visitor_count).

    ``approximate`` uses HyperLogLog++ (``approx_count_distinct`` with relative
    standard deviation ``rsd``): fixed-size sketches instead of a distinct pass."""
    agg = F.approx_count_distinct("user_id", rsd) if approximate else F.count_distinct("user_id")
    return binned.groupBy("t", "region").agg(agg.alias("visitor_count"))


#: room for a file position below the microseconds in a first-visit key
_SEQ = "CAST(10000000000000000000 AS DECIMAL(20,0))"


def event_cells(binned: DataFrame) -> DataFrame:
    """The one event-level aggregate behind AG2-AG9: per (t, region, user, venue) the row
    count and ``first``, the smallest (ts, seq) as one number (microseconds * 10^19 + seq).

    All buffers are fixed-width numbers, so both sides of the exchange use a hash
    aggregate: no sort of the events.  Groups with a NULL user or venue are kept; the region
    list and the time bounds are read off this table too."""
    seq = F.coalesce(F.col("seq"), F.lit(0)) if "seq" in binned.columns else F.lit(0)
    key = F.expr(f"CAST(_us AS DECIMAL(18,0)) * {_SEQ} + CAST(_seq AS DECIMAL(20,0))").cast("decimal(38,0)")
    keyed = binned.withColumn("_us", ntz_epoch_micros("ts")).withColumn("_seq", seq).withColumn("_key", key)
    return keyed.groupBy("t", "region", "user_id", "venue_id").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("first"))


def cell_user_all(binned: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Per (t, region, user) the non-null venue count and the row count, the NULL-user
    group included."""
    if events is None:
        return binned.groupBy("t", "region", "user_id").agg(F.count("venue_id").alias("reg_time_visits"), F.count(F.lit(1)).alias("n_rows"))
    return events.groupBy("t", "region", "user_id").agg(
        F.sum(F.when(F.col("venue_id").isNotNull(), F.col("n")).otherwise(0)).alias("reg_time_visits"), F.sum("n").alias("n_rows"))


def user_cell_visits(binned: DataFrame, cells_all: DataFrame | None = None) -> DataFrame:
    """AG4: visits per (t, region, user) = non-null venue count, plus the row count."""
    cells_all = cell_user_all(binned) if cells_all is None else cells_all
    return cells_all.filter(F.col("user_id").isNotNull())


def user_totals(binned: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """AG5: total visits per user over all cells: (user_id, total_visits).

    Summed from the (t, region, user) aggregate, so no second pass over the events."""
    cells = user_cell_visits(binned) if cells is None else cells
    return cells.groupBy("user_id").agg(F.sum("reg_time_visits").alias("total_visits"))


def visit_probability(binned: DataFrame, cells_all: DataFrame | None = None) -> DataFrame:
    """JN4 / PF17: p = user's visits in the cell / user's visits everywhere, all time."""
    cells = user_cell_visits(binned, cells_all)
    totals = user_totals(binned, cells)
    j = cells.join(totals, "user_id")
    return j.select(
        "t", "region", "user_id", "reg_time_visits", "total_visits", "n_rows",
        ratio("reg_time_visits", "total_visits").alias("probability"),
    )


def cell_stats(binned: DataFrame, cells_all: DataFrame | None = None) -> DataFrame:
    """AG2 + AG3 + AG6 from one (t, region, user) aggregate:
    (t, region, visitor_count, obs_freq, visitor_entropy)."""
    p = visit_probability(binned, cells_all)
    return p.groupBy("t", "region").agg(
        F.count(F.lit(1)).alias("visitor_count"),
        F.sum("n_rows").alias("obs_freq"),
        no_negative_zero(F.coalesce(F.sum(entropy_term("probability")), F.lit(0.0))).alias("visitor_entropy"),
    )


def visitor_entropy(binned: DataFrame) -> DataFrame:
    """AG6: sum over users of -p log2 p per (t, region)."""
    return cell_stats(binned).select("t", "region", "visitor_entropy")


def region_popularity(cells: DataFrame, obs_col: str = "obs_freq") -> DataFrame:
    """AG7 / AG21: share of the interval's check-ins; empty interval -> NULL (0 after fill)."""
    w = Window.partitionBy("t")
    return cells.withColumn("region_popularity", ratio(F.col(obs_col), F.sum(obs_col).over(w)))


# --------------------------------------------------------------- favourite venues

def user_venue_stats(binned: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """AG8 + WN2 in one aggregate: visits per (user, venue) and the key of the first one."""
    events = event_cells(binned) if events is None else events
    return (
        events.filter(F.col("user_id").isNotNull() & F.col("venue_id").isNotNull())
        .groupBy("user_id", "venue_id")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )


def user_venue_count(binned: DataFrame) -> DataFrame:
    """AG8: (user_id, venue_id, n)."""
    return user_venue_stats(binned).select("user_id", "venue_id", "n")


def top_venues(uv: DataFrame, k: int = 4) -> DataFrame:
    """WN1: the k most visited venues per user, ties broken by venue id.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before the
    exchange, so a heavy user ships at most k rows per map partition.
    """
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col("venue_id").asc())
    return uv.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_visits(binned: DataFrame, k: int = 4, events: DataFrame | None = None) -> DataFrame:
    """JN5 + WN2: first visit of each user's top-k venues: (user_id, venue_id, ts, t, region).

    Bin and region of the first visit are fetched for the kept (user, venue) pairs only;
    of rows that share user, venue, time and position the smallest region counts."""
    events = event_cells(binned) if events is None else events
    top = top_venues(user_venue_stats(binned, events), k).select("user_id", "venue_id", "first")
    met = events.select("user_id", "venue_id", "first", "t", "region").join(top, ["user_id", "venue_id", "first"])
    # a sorted set, as a minimum of text would need a sorting aggregate
    one = met.groupBy("user_id", "venue_id", "first", "t").agg(F.array_min(F.collect_set("region")).alias("region"))
    us = F.expr(f"CAST(floor(first / {_SEQ}) AS BIGINT)")
    return one.select("user_id", "venue_id", ntz_from_epoch_micros(us).alias("ts"), "t", "region")


def first_visit_counts(binned: DataFrame, k: int = 4, events: DataFrame | None = None) -> DataFrame:
    """AG9 numerator: first visits to top-k venues per (t, region)."""
    return first_visits(binned, k, events).groupBy("t", "region").agg(F.count(F.lit(1)).alias("first_visits"))


def visitor_ratio(binned: DataFrame, k: int = 4) -> DataFrame:
    """AG9: first visits / obs_freq per observed (t, region); no obs -> NULL."""
    fv = first_visit_counts(binned, k)
    obs = obs_freq(binned)
    return obs.join(fv, ["t", "region"], "left").select(
        "t", "region", ratio(F.coalesce("first_visits", F.lit(0)), "obs_freq").alias("visitor_ratio")
    )


# ---------------------------------------------------------------- whole matrix

def feature_matrix(checkins: DataFrame, config: PipelineConfig = DEFAULT) -> DataFrame:
    """JN6 / PF15: the five features on the dense spine x region grid, missing -> 0.

    (t, region, visitor_count, obs_freq, visitor_entropy, visitor_ratio, region_popularity)

    ``event_cells`` feeds every other aggregate (counts, entropy, user totals, first visits,
    region list, time bounds), so it is written once to the shared checkpoint folder when
    this is called: the check-ins are scanned once, whatever their size.
    """
    binned = binned_checkins(checkins, config.interval)
    events = write_once(event_cells(binned), "event-cells")
    cells_all = cell_user_all(binned, events)
    stats = cell_stats(binned, cells_all)
    fv = first_visit_counts(binned, config.top_k, events)
    grid = grid_of(events.select("region"), events, config.interval)
    cells = stats.join(fv, ["t", "region"], "left")
    dense = densify_grid(
        cells, grid, ["visitor_count", "obs_freq", "visitor_entropy", "first_visits"]
    )
    dense = dense.withColumn(
        "visitor_ratio", F.coalesce(ratio("first_visits", "obs_freq"), F.lit(0.0))
    )
    dense = region_popularity(dense).withColumn(
        "region_popularity", F.coalesce("region_popularity", F.lit(0.0))
    )
    return dense.select(
        "t", "region",
        F.col("visitor_count").cast("long").alias("visitor_count"),
        F.col("obs_freq").cast("long").alias("obs_freq"),
        F.col("visitor_entropy").cast("double").alias("visitor_entropy"),
        "visitor_ratio", "region_popularity",
    )


def feature_long(matrix: DataFrame) -> DataFrame:
    """The matrix as (t, region, feature, value) rows, feature in the fixed order."""
    stack = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in FEATURES)
    return matrix.selectExpr("t", "region", f"stack({len(FEATURES)}, {stack}) AS (feature, value)")
