"""regionpulse: spatio-temporal region features on Spark DataFrames.

Every public operator takes DataFrames and returns a lazy DataFrame; nothing
is collected unless an operator's contract is a scalar report.
"""

import sys as _sys

from regionpulse.config import PipelineConfig


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside Spark task closures, so Python
    workers never need the package installed (Pandas UDF code travels with the task)."""
    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()

__all__ = ["PipelineConfig"]
