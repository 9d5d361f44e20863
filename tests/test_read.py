"""Read-side operators."""

import datetime as dt

from transcript_lake.operators import read as RD
from transcript_lake.sources.tables import SAMPLE_CONTENT, or_sample

SCHEMA = "id string, created_at timestamp_ntz, content string"
AS_OF = dt.datetime(2024, 3, 31, 12, 0, 0)


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_window_bound_is_inclusive(spark):
    df = _df(spark, [
        ("on", AS_OF - dt.timedelta(days=30), "x"),
        ("before", AS_OF - dt.timedelta(days=30, microseconds=1), "x"),
        ("future", AS_OF + dt.timedelta(days=1), "x"),
    ])
    got = {r.id for r in RD.recent(df, 30, AS_OF).collect()}
    assert got == {"on", "future"}


def test_on_day_and_count(spark):
    df = _df(spark, [("a", AS_OF, "x"), ("b", AS_OF.replace(hour=0), "y"),
                     ("c", AS_OF - dt.timedelta(days=1), "z")])
    assert RD.rows_on_day(df, AS_OF).collect()[0].row_count == 2


def test_any_row(spark):
    df = _df(spark, [("a", AS_OF, "x")])
    assert RD.any_row(df).count() == 1
    assert RD.any_row(df.filter("id = 'none'")).count() == 0


def test_preview_is_characters(spark):
    text = "é" * 60
    r = RD.preview(_df(spark, [("a", AS_OF, text)]), 5, order_by="id").collect()[0]
    assert r.content_length == 60 and r.content_preview == "é" * 50


def test_daily_stats_newest_seven(spark):
    rows = [(f"r{i}", AS_OF - dt.timedelta(days=i), "ab" * (i + 1)) for i in range(10)]
    out = RD.daily_stats(_df(spark, rows)).collect()
    assert len(out) == 7
    assert out[0].date == AS_OF.date() and out[0].avg_content_length == 2.0


def test_fallback_only_when_empty(spark):
    df = _df(spark, [("a", AS_OF, "x")])
    assert [r.id for r in or_sample(df, AS_OF).collect()] == ["a"]
    rows = sorted(or_sample(df.filter("id = 'none'"), AS_OF).collect())
    assert [r.id for r in rows] == [f"ml-test-{i}" for i in range(5)]
    assert rows[2].created_at == AS_OF - dt.timedelta(days=2)
    assert rows[4].content == SAMPLE_CONTENT[4]


def test_default_clock_is_utc_in_any_session_zone(spark):
    from transcript_lake.functions.time import as_of_col
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ["America/Los_Angeles", "Asia/Tokyo"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = spark.range(1).select(as_of_col(None).alias("t")).collect()[0].t
            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            assert abs((now - got).total_seconds()) < 120
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_flat_folder_reads_like_a_partitioned_one(spark, tmp):
    """A folder written without date partitions keeps all its rows under every window."""
    from pyspark.sql import functions as F

    from transcript_lake.operators import read as RD
    from transcript_lake.sources import sinks as SK
    from transcript_lake.sources.tables import read_table

    rows = spark.range(100).select(
        F.concat(F.lit("t"), F.col("id")).alias("id"),
        F.expr("timestamp_ntz'2024-01-10 12:00:00' - make_dt_interval(cast(id % 9 as int))").alias("created_at"),
        F.lit("some text").alias("content"))
    rows.write.parquet(f"{tmp}/flat")
    SK.append(rows, f"{tmp}/dated")
    clock = F.expr("timestamp_ntz'2024-01-10 23:00:00'")
    for of in (lambda t: RD.recent(t, 30, clock).count(), lambda t: RD.rows_on_day(t, clock).first()[0],
               lambda t: sorted(map(tuple, RD.daily_stats(t).collect()))):
        flat, dated = (of(read_table(spark, f"{tmp}/{n}")) for n in ("flat", "dated"))
        assert flat == dated and flat


def test_upload_times_need_the_exact_form(spark):
    from transcript_lake.sources import sinks as SK

    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:00+05:00", "2024-01-01T00:00:00Z", "2024", "2024-01",
             "2024-13-01 00:00:00", " 2024-01-01 00:00:00"]
    raw = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(times)], "id string, created_at string, content string")
    good, bad = SK.validate(raw)
    assert [r.id for r in good.collect()] == ["0"]
    assert {r.id for r in bad.collect()} == {"1", "2", "3", "4", "5", "6"}
