"""Row-wise ingest of uploads into a transcripts landing table.

Files of raw rows (all text) arrive in a folder; each micro-batch is
validated once, good rows go to the table and bad rows, with their messages,
to an error table. A stream cannot refuse "the whole upload", so rows are
routed one by one (the insert API's skip-invalid mode).

Exactly-once: both tables are versioned folders that remember the last batch
of each stream, so a batch replayed after a failure is skipped by the table that
has it and written to the one that has not. Writes of a date are merged when there
are ``MERGE_AT`` of them, so files stay bounded over any number of micro-batches.
Other writers may use the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.schemas import RAW_TRANSCRIPTS, TRANSCRIPTS
from ..sources.sinks import MERGE_AT, append_batch, validate
from ..sources.tables import read_table

#: The error table: raw values and the messages.
ERROR_ROWS = T.StructType([*RAW_TRANSCRIPTS.fields, T.StructField("errors", T.StringType())])


def batch_writer(table_path: str, error_path: str, stream: str = "ingest", merge_at: int = MERGE_AT):
    """The foreachBatch function: validate once, route, write each batch once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = validate(batch, TRANSCRIPTS)
            append_batch(good, table_path, TRANSCRIPTS, stream, batch_id, merge_at)
            append_batch(bad, error_path, ERROR_ROWS, stream, batch_id, merge_at)
        finally:
            batch.unpersist()
    return write


def ingest_error_rows(spark: SparkSession, error_path: str) -> DataFrame:
    """The refused rows: their raw values and ``errors``."""
    return read_table(spark, error_path, ERROR_ROWS)


def start_ingest(spark: SparkSession, source_dir: str, table_path: str, error_path: str,
                 checkpoint: str, fmt: str = "parquet", available_now: bool = False,
                 processing_time: str | None = None) -> StreamingQuery:
    """Start the ingest stream; ``checkpoint`` must be on shared storage and names the stream."""
    stream = spark.readStream.schema(RAW_TRANSCRIPTS).format(fmt).load(source_dir)
    writer = (stream.writeStream.foreachBatch(batch_writer(table_path, error_path, checkpoint))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
