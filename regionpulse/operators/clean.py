"""Incident cleaning: lenient date/time parsing, date range, category filter."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpulse.functions import combine_date_time, lenient_date, lenient_time


def parse_incident_time(
    df: DataFrame,
    date_col: str = "date_text",
    time_col: str = "time_text",
    out: str = "ts",
    source_tz: str | None = None,
) -> DataFrame:
    """PF6-PF8, PF10, ST1: parse the start date and the (end) time leniently, drop rows
    where either failed (one OR predicate instead of a union of two drop lists), and
    combine them into one timestamp.  ``source_tz`` converts local wall-clock time to UTC.
    """
    parsed = df.withColumn("_d", lenient_date(date_col)).withColumn("_t", lenient_time(time_col))
    kept = parsed.filter(~(F.col("_d").isNull() | F.col("_t").isNull()))
    ts = combine_date_time("_d", "_t")
    if source_tz:
        ts = F.convert_timezone(F.lit(source_tz), F.lit("UTC"), ts)
    return kept.withColumn(out, ts).withColumnRenamed("_d", "date").drop("_t")


def filter_date_range(df: DataFrame, start: str, end: str, col: str = "ts") -> DataFrame:
    """PF9: inclusive calendar-date range on ``col`` (both ends are whole days)."""
    d = F.to_date(F.col(col))
    return df.filter(d.between(F.lit(_dt.date.fromisoformat(start)), F.lit(_dt.date.fromisoformat(end))))


def filter_category(df: DataFrame, value: str, col: str = "offense") -> DataFrame:
    """PF11: keep one offence category."""
    return df.filter(F.col(col) == value)


def clean_incidents(
    raw: DataFrame,
    start: str,
    end: str,
    category: str | None,
    date_col: str = "date_text",
    time_col: str = "time_text",
    category_col: str = "offense",
) -> DataFrame:
    """Whole cleaning chain; the category predicate is written first so that it reaches
    the scan together with the date predicate."""
    df = raw if category is None else filter_category(raw, category, category_col)
    df = parse_incident_time(df, date_col, time_col)
    return filter_date_range(df, start, end, "date")
