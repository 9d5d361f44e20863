"""Read-side operators over a transcripts table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_count, preview_text
from ..functions.time import as_of_col, days
from ..sources.schemas import PARTITION_COLUMN


def prune_dates(df: DataFrame, lower_ts: Column) -> DataFrame:
    """Add a partition-column bound implied by a timestamp bound.

    Spark does not derive partition filters from a filter on a data column,
    so tables written partitioned by date get the date bound spelled out;
    whole directories are then skipped at planning or run time.
    """
    if PARTITION_COLUMN in df.columns:
        return df.filter(F.col(PARTITION_COLUMN) >= F.to_date(lower_ts))
    return df


def recent(df: DataFrame, n_days: int, as_of=None, ts: str = "created_at") -> DataFrame:
    """Rows with ``ts >= as_of - n_days``; the bound is inclusive, no upper bound."""
    lower = as_of_col(as_of) - days(n_days)
    return prune_dates(df, lower).filter(F.col(ts) >= lower)


def on_day(df: DataFrame, day, ts: str = "created_at") -> DataFrame:
    """Rows whose calendar date is ``day`` (Catalyst turns it into a range)."""
    day_col = day if isinstance(day, Column) else F.lit(day).cast("date")
    if PARTITION_COLUMN in df.columns:
        df = df.filter(F.col(PARTITION_COLUMN) == day_col)
    return df.filter(F.to_date(F.col(ts)) == day_col)


def count_rows(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def rows_on_day(df: DataFrame, as_of=None, ts: str = "created_at") -> DataFrame:
    """COUNT(*) of rows dated on the run's calendar day."""
    return count_rows(on_day(df, F.to_date(as_of_col(as_of)), ts))


def any_row(df: DataFrame) -> DataFrame:
    """Existence probe: one row if the table has any, else none."""
    return df.limit(1).select(F.lit(1).alias("ok"))


def _or_own(df: DataFrame, name: str, value: Column) -> Column:
    """The column ``name`` where an earlier step has measured it, else ``value``."""
    return (F.col(name) if name in df.columns else value).alias(name)


def preview(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """id, created_at, length and the first 50 characters of ``n`` rows.

    Without ``order_by`` any ``n`` rows qualify (as in the source query);
    with it the choice is repeatable and runs as a per-partition top-k. Rows may
    come with ``content_length`` and ``content_preview`` measured and without the text.
    """
    out = df.select(
        "id", "created_at",
        _or_own(df, "content_length", char_count(F.col("content"))),
        _or_own(df, "content_preview", preview_text(F.col("content"))),
    )
    if order_by:
        out = out.orderBy(order_by)
    return out.limit(n)


def daily_stats(df: DataFrame, n_days: int = 7) -> DataFrame:
    """Per calendar day: count, mean length, first and last timestamp.

    Lengths are computed before the shuffle, so only a handful of numbers
    per row and day leave each task; newest ``n_days`` days are kept. Rows may
    come with ``content_length`` measured and without the text.
    """
    day = (F.col(PARTITION_COLUMN) if PARTITION_COLUMN in df.columns
           else F.to_date("created_at"))
    return (df.groupBy(day.alias("date"))
              .agg(F.count(F.lit(1)).alias("transcript_count"),
                   F.round(F.avg(_or_own(df, "content_length", F.length("content"))), 6).alias("avg_content_length"),
                   F.min("created_at").alias("earliest_transcript"),
                   F.max("created_at").alias("latest_transcript"))
              .orderBy(F.desc("date"))
              .limit(n_days))
