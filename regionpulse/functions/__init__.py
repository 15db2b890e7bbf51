"""Column-expression helpers; all JVM-side built-ins, no Python UDFs."""

from regionpulse.functions.exprs import (
    dot,
    entropy_term,
    instant_to_ntz,
    interval_expr,
    l2_norm,
    ntz_epoch_micros,
    ntz_epoch_seconds,
    ntz_from_epoch_micros,
    ntz_to_instant,
    no_negative_zero,
    ratio,
    time_bin,
)
from regionpulse.functions.timeparse import (
    lenient_date,
    lenient_time,
    combine_date_time,
)

__all__ = [
    "dot",
    "entropy_term",
    "instant_to_ntz",
    "interval_expr",
    "ntz_epoch_micros",
    "ntz_epoch_seconds",
    "ntz_from_epoch_micros",
    "ntz_to_instant",
    "l2_norm",
    "no_negative_zero",
    "ratio",
    "time_bin",
    "lenient_date",
    "lenient_time",
    "combine_date_time",
]
