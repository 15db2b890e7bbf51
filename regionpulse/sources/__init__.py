"""Readers and writers (CSV, parquet, polygon text) and adapters for the test tables."""

from regionpulse.sources.files import (
    CHECKIN_SCHEMA,
    INCIDENT_SCHEMA,
    load_checkins,
    load_incidents,
    load_model_table,
    load_regions,
    read_table,
    write_csv,
    write_table,
)

__all__ = [
    "CHECKIN_SCHEMA",
    "INCIDENT_SCHEMA",
    "load_checkins",
    "load_incidents",
    "load_model_table",
    "load_regions",
    "read_table",
    "write_csv",
    "write_table",
]
