"""Streaming counter of unexpected token requests.

The batch form is ``operators.audit.suspicious_counts``. There are two streams:

* ``start_suspicious_updates`` adds every micro-batch's counts to a versioned
  log. It loses nothing: late entries count in their window and are reported
  apart, unreadable ones go to an error table.
* ``suspicious_stream`` / ``start_suspicious`` keep state per tumbling window
  and write a window once, when the watermark passes its end. Late rows are
  dropped by Spark when they are older than the previous micro-batch's
  watermark (its rule since 3.4, so that chained stateful operators agree).

Watermarks need TIMESTAMP, not TIMESTAMP_NTZ: the zone-less log time is cast
to TIMESTAMP, which is exact with the session zone set to UTC, and the
window bounds are cast back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import audit_unexpected, parse_audit, split_audit
from ..sources import versions as V
from ..sources.schemas import AUDIT_ERRORS
from ..sources.sinks import MERGE_AT, append_batch
from ..sources.tables import read_table


def suspicious_stream(spark: SparkSession, source_dir: str, expected: str,
                      window: str = "1 minute", watermark: str = "10 minutes",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of (window_start, window_end, suspicious_count)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    audit = parse_audit(reader.load(source_dir), col="value")
    hits = (audit_unexpected(audit, expected)
            .withColumn("event_time", F.col("ts").cast("timestamp"))
            .withWatermark("event_time", watermark))
    return (hits.groupBy(F.window("event_time", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("suspicious_count"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "suspicious_count"))


def start_suspicious(spark: SparkSession, source_dir: str, sink_path: str, checkpoint: str,
                     expected: str, window: str = "1 minute", watermark: str = "10 minutes",
                     available_now: bool = False, processing_time: str | None = None):
    """Run the counter into Parquet files (append mode: a window is written
    once, when the watermark closes it). ``checkpoint`` must be on shared
    storage; the file sink and the state store make the output exactly-once."""
    counts = suspicious_stream(spark, source_dir, expected, window, watermark)
    writer = (counts.writeStream.outputMode("append").format("parquet")
              .option("path", sink_path).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


#: A row of the count log: what one micro-batch adds to a window.
COUNTS = T.StructType([
    T.StructField("window_start", T.TimestampNTZType()), T.StructField("window_end", T.TimestampNTZType()),
    T.StructField("suspicious_count", T.LongType()), T.StructField("late_count", T.LongType()),
    T.StructField("last_event", T.TimestampNTZType()),
])


def _merged(rows: DataFrame) -> DataFrame:
    """One row for a window."""
    return rows.groupBy("window_start", "window_end").agg(
        F.sum("suspicious_count").alias("suspicious_count"), F.sum("late_count").alias("late_count"),
        F.max("last_event").alias("last_event"))


def _seen(spark: SparkSession, log_path: str) -> dt.datetime | None:
    """The newest event time of all batches before, from the log's version file."""
    version = V.head(spark, log_path)
    last = [s.bounds["last_event"][1] for s in version.segments if "last_event" in s.bounds] if version else []
    return dt.datetime.fromisoformat(max(last, key=dt.datetime.fromisoformat)) if last else None


def start_suspicious_updates(spark: SparkSession, source_dir: str, log_path: str, checkpoint: str,
                             expected: str, window: str = "1 minute", watermark: str = "10 minutes",
                             available_now: bool = False, processing_time: str | None = None,
                             error_path: str | None = None, max_files_per_trigger: int | None = None,
                             merge_at: int = MERGE_AT):
    """Run the counter into a log of counts, without losing a late entry.

    Each micro-batch adds its own counts per window to a versioned table, once
    however often it is replayed; ``current_counts`` sums them. Nothing is kept in
    a state store, so no entry is ever too late to count: ``late_count`` says how many
    of a window's entries came after it was closed, that is, with the window's end
    ``watermark`` or more behind the newest entry of the batches before. The log is
    merged to one row per window every ``merge_at`` batches. With
    ``error_path`` entries that cannot be read go to a table of their own
    (``audit_error_rows``). ``checkpoint`` must be on shared storage and names the stream.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist() if error_path else batch
        try:
            good, bad = split_audit(batch, "value")
            seen = _seen(spark, log_path)
            closed = F.lit(seen) - F.expr(f"INTERVAL {watermark}") if seen else F.lit(None).cast("timestamp_ntz")
            counts = (audit_unexpected(good, expected).groupBy(F.window("ts", window).alias("w"))
                      .agg(F.count(F.lit(1)).alias("suspicious_count"), F.max("ts").alias("last_event"))
                      .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "suspicious_count",
                              F.when(F.col("w.end") <= closed, F.col("suspicious_count")).otherwise(0).alias("late_count"),
                              "last_event"))
            append_batch(counts, log_path, COUNTS, checkpoint, batch_id, merge_at, _merged)
            if error_path:
                append_batch(bad, error_path, AUDIT_ERRORS, checkpoint, batch_id, merge_at)
        finally:
            if error_path:
                batch.unpersist()

    writer = reader.load(source_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def count_log(spark: SparkSession, log_path: str) -> DataFrame:
    """(window_start, window_end, suspicious_count, late_count, last_event) of every window; a quiet log has none."""
    if V.head(spark, log_path) is None:
        return spark.createDataFrame([], COUNTS)
    return _merged(read_table(spark, log_path, COUNTS))


def current_counts(spark: SparkSession, log_path: str) -> DataFrame:
    """The count of every window so far (one aggregation of the log)."""
    return count_log(spark, log_path).select("window_start", "window_end", "suspicious_count")


def audit_error_rows(spark: SparkSession, error_path: str) -> DataFrame:
    """(entry, errors) of the entries that the stream could not read."""
    return read_table(spark, error_path, AUDIT_ERRORS)
