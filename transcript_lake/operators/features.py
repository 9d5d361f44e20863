"""Simulated model features and their reports."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOPICS, char_count, draw, keyed_hash, pick, uniform, word_count
from ..functions.time import as_of_col, days
from ..sources.schemas import PROCESSED

# Salt of the keyed draws; changing it changes every simulated score.
DRAW_SALT = "ml"


def features(df: DataFrame, as_of=None,
             scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Feature columns of the processed table, in declared order.

    word_count and char_count are exact; avg_word_length is char_count /
    word_count (spaces included, NULL for zero words). Sentiment, topic
    confidence and topic are draws keyed by ``id``: the same id always gets
    the same values, whatever the partitioning. ``scorer`` may supply a real
    sentiment model as a column function, e.g. a pandas UDF over content.
    Input columns outside the declared schema are passed through at the end.
    Rows may come with ``word_count`` and ``char_count`` measured.
    """
    content = F.col("content")
    names = PROCESSED.fieldNames()
    extra = [c for c in df.columns if c not in names]
    base = df.select(
        "id", "created_at", "content", *extra,
        (F.col("word_count") if "word_count" in df.columns else word_count(content)).alias("word_count"),
        (F.col("char_count") if "char_count" in df.columns else char_count(content)).alias("char_count"),
        keyed_hash(F.col("id"), DRAW_SALT).alias("_h"),
    )
    sentiment = scorer(content) if scorer else uniform(draw(F.col("_h"), 0), -1.0, 1.0)
    out = base.select(
        "id", "created_at", "content", "word_count", "char_count",
        F.try_divide(F.col("char_count"), F.col("word_count")).alias("avg_word_length"),
        sentiment.cast("double").alias("sentiment_score"),
        uniform(draw(F.col("_h"), 1), 0.5, 1.0).alias("topic_confidence"),
        pick(draw(F.col("_h"), 2), TOPICS).alias("predicted_topic"),
        as_of_col(as_of).alias("processing_timestamp"),
        *extra,
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in PROCESSED.fields], *extra)


def topic_summary(processed: DataFrame) -> DataFrame:
    """Per topic: count, mean sentiment, mean words; largest first.

    Few topics, so the partial aggregate leaves each task with a few rows.
    """
    return (processed.groupBy("predicted_topic")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.round(F.avg("sentiment_score"), 6).alias("avg_sentiment"),
                 F.round(F.avg("word_count"), 6).alias("avg_words"))
            .orderBy(F.desc("count"), "predicted_topic"))


def processing_history(processed: DataFrame, as_of=None, n_days: int = 7,
                       approximate: bool = False) -> DataFrame:
    """Per run date over the last ``n_days``: distinct ids and topics, first
    and last run time; newest first.

    Exact distinct counts plan as one Expand plus two aggregation levels;
    ``approximate=True`` trades exactness for one HyperLogLog pass.
    """
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    lower = as_of_col(as_of) - days(n_days)
    return (processed.filter(F.col("processing_timestamp") >= lower)
            .groupBy(F.to_date("processing_timestamp").alias("process_date"))
            .agg(distinct("id").alias("transcripts_processed"),
                 distinct("predicted_topic").alias("unique_topics"),
                 F.min("processing_timestamp").alias("first_process_time"),
                 F.max("processing_timestamp").alias("last_process_time"))
            .orderBy(F.desc("process_date")))
