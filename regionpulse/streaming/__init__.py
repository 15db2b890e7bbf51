"""Structured Streaming versions of the tumbling-window aggregates."""

from regionpulse.streaming.windowed import (
    latest_bins,
    read_checkin_stream,
    streaming_cell_counts,
    streaming_incident_labels,
    upsert_stream_to_table,
    write_stream_to_table,
)

__all__ = [
    "latest_bins",
    "read_checkin_stream",
    "streaming_cell_counts",
    "streaming_incident_labels",
    "upsert_stream_to_table",
    "write_stream_to_table",
]
