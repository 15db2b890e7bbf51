"""Lenient date/time parsing: bad input becomes NULL instead of failing the job.

``try_to_timestamp`` returns NULL for text that does not match (e.g. month 13,
hour 24) under ANSI mode, matching a coercing parser.  Spark happily accepts
year 1015, so a lower bound on the year is applied explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats of the incident source (month/day/year, 24-hour time).  Single
# letters accept one or two digits, like a C-style %m/%d/%Y and %H:%M:%S.
DATE_FORMAT = "M/d/yyyy"
TIME_FORMAT = "H:m:s"
MIN_YEAR = 1678  # earliest year a nanosecond timestamp can hold
MAX_YEAR = 2261


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_date(c, fmt: str = DATE_FORMAT) -> Column:
    ts = F.try_to_timestamp(_col(c), F.lit(fmt))
    d = F.to_date(ts)
    return F.when(F.year(d).between(MIN_YEAR, MAX_YEAR), d)


def lenient_time(c, fmt: str = TIME_FORMAT) -> Column:
    """Canonical 'HH:mm:ss' text of a valid time of day, else NULL."""
    ts = F.try_to_timestamp(_col(c), F.lit(fmt))
    return F.when(ts.isNotNull(), F.date_format(ts, "HH:mm:ss"))


def combine_date_time(date_col, time_col) -> Column:
    """Timestamp (NTZ) from a DATE and an 'HH:mm:ss' string."""
    text = F.concat_ws(" ", F.date_format(_col(date_col), "yyyy-MM-dd"), _col(time_col))
    return text.try_cast("timestamp_ntz")  # no session zone, so no hour that a zone skips
