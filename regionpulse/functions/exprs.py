"""Scalar building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_bin(ts, interval: str = "3 hours") -> Column:
    """Start of the left-closed, epoch-aligned tumbling bin that holds ``ts``.

    ``window`` keeps the input's timestamp flavour (NTZ in, NTZ out) and is a
    plain projection for tumbling windows, so it stays inside whole-stage codegen.
    """
    return F.window(_col(ts), interval).start


def interval_expr(interval: str) -> Column:
    return F.expr(f"INTERVAL {interval}")


def no_negative_zero(c) -> Column:
    """x + 0.0 turns -0.0 into 0.0 and leaves every other value unchanged."""
    return _col(c) + F.lit(0.0)


def entropy_term(p, base: str = "2") -> Column:
    """-p * log(p); log of 0 is NULL in Spark, so such terms drop out of sums."""
    p = _col(p)
    logp = F.log2(p) if base == "2" else F.ln(p)
    return no_negative_zero(-p * logp)


def ratio(num, den) -> Column:
    """num / den with NULL (not an ANSI error) when den is 0 or NULL."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def dot(a, b) -> Column:
    """Dot product of two numeric arrays of equal length, as a native expression."""
    prod = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ wall clock, independent of the
    session time zone (a cast to TIMESTAMP would shift it by the zone offset)."""
    return F.timestamp_diff("SECOND", F.expr(_NTZ_EPOCH), _col(ts))


def ntz_epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ wall clock (zone independent)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_NTZ_EPOCH), _col(ts))


def ntz_from_epoch_micros(micros) -> Column:
    """The TIMESTAMP_NTZ wall clock that many microseconds after 1970-01-01."""
    return F.timestamp_add("MICROSECOND", _col(micros), F.expr(_NTZ_EPOCH))


def ntz_to_instant(ts) -> Column:
    """TIMESTAMP_NTZ wall clock read as UTC -> TIMESTAMP instant (zone independent)."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(_NTZ_EPOCH), _col(ts))
    return F.timestamp_micros(micros)


def instant_to_ntz(ts) -> Column:
    """TIMESTAMP instant -> its UTC wall clock as TIMESTAMP_NTZ (zone independent)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_col(ts)), F.expr(_NTZ_EPOCH))
