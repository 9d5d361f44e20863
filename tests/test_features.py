"""Feature columns: edge rows and partition invariance."""

import datetime as dt

from pyspark.sql import functions as F

from transcript_lake.functions.text import TOPICS
from transcript_lake.operators.features import features, processing_history, topic_summary
from transcript_lake.sources import fixtures as FX
from transcript_lake.sources.schemas import PROCESSED
from conftest import MEDIUM

AS_OF = "2024-02-01 00:00:00"


def _one(spark, content):
    df = spark.createDataFrame([("x1", dt.datetime(2024, 1, 1), content)],
                               "id string, created_at timestamp_ntz, content string")
    return features(df, AS_OF).collect()[0]


def test_blank_content_has_no_words(spark):
    for text in ["", " ", "\t\n "]:
        r = _one(spark, text)
        assert r.word_count == 0
        assert r.avg_word_length is None


def test_words_split_like_python(spark):
    for text in ["a b", "  lead and trail  ", "x　y z", "a\x1cb", "one"]:
        assert _one(spark, text).word_count == len(text.split()), repr(text)


def test_length_counts_characters(spark):
    r = _one(spark, "café naïve")
    assert r.char_count == len("café naïve")
    assert r.avg_word_length == len("café naïve") / 2


def test_schema_is_declared_order(spark):
    df = features(FX.transcripts(spark, MEDIUM), AS_OF)
    assert df.schema.fieldNames() == PROCESSED.fieldNames()
    assert [f.dataType for f in df.schema.fields] == [f.dataType for f in PROCESSED.fields]


def test_partition_invariance(spark):
    t = FX.transcripts(spark, MEDIUM)
    cols = ["id", "word_count", "sentiment_score", "topic_confidence", "predicted_topic"]
    a = sorted(features(t.repartition(1), AS_OF).select(cols).collect())
    b = sorted(features(t.repartition(17), AS_OF).select(cols).collect())
    assert a == b


def test_draw_ranges(spark):
    r = (features(FX.transcripts(spark, MEDIUM), AS_OF)
         .agg(F.min("sentiment_score"), F.max("sentiment_score"),
              F.min("topic_confidence"), F.max("topic_confidence"),
              F.collect_set("predicted_topic")).collect()[0])
    assert -1 <= r[0] < r[1] < 1
    assert 0.5 <= r[2] < r[3] < 1
    assert sorted(r[4]) == sorted(TOPICS)


def test_topic_ties_ordered_by_topic(spark):
    df = spark.createDataFrame(
        [("b", 0.5, 3), ("a", 0.1, 1), ("b", 0.5, 1), ("a", 0.3, 3), ("c", 0.0, 1)],
        "predicted_topic string, sentiment_score double, word_count long")
    rows = topic_summary(df).collect()
    assert [r.predicted_topic for r in rows] == ["a", "b", "c"]
    assert rows[0]["count"] == 2 and rows[0].avg_sentiment == 0.2 and rows[0].avg_words == 2.0


def test_history_keeps_last_week(spark):
    runs = FX.processed_runs(spark, MEDIUM)
    rows = processing_history(runs, FX.as_of(spark, MEDIUM), 7).collect()
    assert len(rows) == 2
    assert rows[0].process_date > rows[1].process_date
    approx = processing_history(runs, FX.as_of(spark, MEDIUM), 7, approximate=True).collect()
    assert len(approx) == 2


def test_scorer_hook_runs_as_arrow_batches(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def polarity(content: pd.Series) -> pd.Series:
        good = content.str.count(r"\bgood\b")
        bad = content.str.count(r"\bbad\b")
        return ((good - bad) / (good + bad).where(good + bad > 0, 1)).astype(float)

    df = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1), "good good bad"), ("b", dt.datetime(2024, 1, 1), "none")],
        "id string, created_at timestamp_ntz, content string")
    out = features(df, AS_OF, scorer=polarity)
    got = {r.id: r.sentiment_score for r in out.collect()}
    assert got == {"a": 1 / 3, "b": 0.0}
    buf = __import__("io").StringIO()
    with __import__("contextlib").redirect_stdout(buf):
        out.explain()
    assert "ArrowEvalPython" in buf.getvalue()
