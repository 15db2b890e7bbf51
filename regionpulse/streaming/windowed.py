"""Streaming variants of the per-(t, region) counts.

obs_freq (AG3), incident counts / labels (AG10, PF14) and visitor counts (AG2) are
tumbling-window aggregates, so they run incrementally with a watermark: a bin is
emitted once the watermark passes its end and its state is dropped.  The exact
distinct count of AG2 would need per-window user sets in state; the streaming form
uses ``approx_count_distinct`` (HyperLogLog++), the batch operator stays exact.
Visitor entropy needs each user's all-time total, so it stays a batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpulse.functions import instant_to_ntz, ntz_to_instant


def read_checkin_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def _event_time(stream: DataFrame, ts_col: str, watermark: str) -> DataFrame:
    # watermarks need a TIMESTAMP instant: read the NTZ wall clock as UTC, so bins
    # equal the batch (NTZ) bins whatever the session time zone is
    s = stream.filter(F.col("region").isNotNull()).withColumn("_et", ntz_to_instant(ts_col))
    return s.withWatermark("_et", watermark)


def _bin(w: str = "w") -> F.Column:
    return instant_to_ntz(F.col(f"{w}.start")).alias("t")


def streaming_cell_counts(stream: DataFrame, interval: str = "3 hours", watermark: str = "6 hours",
                          ts_col: str = "ts") -> DataFrame:
    """(t, region, obs_freq, visitor_count_approx) per closed bin."""
    s = _event_time(stream, ts_col, watermark)
    g = s.groupBy(F.window("_et", interval).alias("w"), "region").agg(
        F.count("user_id").alias("obs_freq"),
        F.approx_count_distinct("user_id").alias("visitor_count_approx"),
    )
    return g.select(_bin(), "region", "obs_freq", "visitor_count_approx")


def streaming_incident_labels(stream: DataFrame, interval: str = "3 hours", watermark: str = "6 hours",
                              ts_col: str = "ts") -> DataFrame:
    """(t, region, n_incidents, label) per closed bin."""
    s = _event_time(stream, ts_col, watermark)
    g = s.groupBy(F.window("_et", interval).alias("w"), "region").agg(F.count(F.lit(1)).alias("n_incidents"))
    return g.select(
        _bin(), "region", "n_incidents",
        F.least(F.col("n_incidents"), F.lit(1)).cast("int").alias("label"),
    )


def upsert_stream_to_table(agg: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Write every change of a bin, open bins included, so that nothing waits for a
    watermark that the end of the input never moves.  Each micro-batch is one folder named
    by its number and overwritten on a retry; ``latest_bins`` reads the last state of each bin."""
    def save_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = agg.writeStream.outputMode("update").foreachBatch(save_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def latest_bins(spark: SparkSession, path: str, keys: tuple[str, ...] = ("t", "region")) -> DataFrame:
    """The last written state of every bin of an upserted table."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def write_stream_to_table(agg: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append closed bins to a parquet table; the checkpoint makes restarts exactly-once."""
    w = agg.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
