"""Property tests: Spark column functions against plain Python."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transcript_lake.functions.text import char_count, word_count
from transcript_lake.operators.features import features

WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
NOT_SPACE = "abé中​﻿\U0001f600-_.,"
texts = st.lists(st.text(alphabet=WHITESPACE + NOT_SPACE, max_size=40), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_word_and_char_count_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: (r.w, r.c) for r in df.select("i", word_count(F.col("s")).alias("w"),
                                              char_count(F.col("s")).alias("c")).collect()}
    assert got == {i: (len(v.split()), len(v)) for i, v in enumerate(values)}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(min_size=1, max_size=12), min_size=1, max_size=30, unique=True))
def test_draws_depend_only_on_id(spark, ids):
    rows = [(x, dt.datetime(2024, 1, 1), "x") for x in ids]
    schema = "id string, created_at timestamp_ntz, content string"
    cols = ["id", "sentiment_score", "topic_confidence", "predicted_topic"]
    a = sorted(features(spark.createDataFrame(rows, schema), "2024-01-02").select(cols).collect())
    b = sorted(features(spark.createDataFrame(rows[::-1], schema).repartition(3), "2024-01-02")
               .select(cols).collect())
    assert a == b
    assert all(-1 <= r.sentiment_score < 1 and 0.5 <= r.topic_confidence < 1 for r in a)
