"""Versioned table folders: what a change touches, what a reader sees, what a question opens."""

import datetime as dt
import glob
import hashlib
import os
import threading

import pytest
from pyspark.sql import functions as F

from transcript_lake.operators.features import processing_history
from transcript_lake.sources import sinks as SK
from transcript_lake.sources import versions as V
from transcript_lake.sources.schemas import PROCESSED, RAW_TRANSCRIPTS, TRANSCRIPTS
from transcript_lake.sources.tables import read_table, recent_or_sample

T0 = dt.datetime(2024, 3, 31, 12, 0, 0)
SCHEMA = "id string, created_at timestamp_ntz, content string"
COLS = TRANSCRIPTS.fieldNames()


def _df(spark, n, start=0, days=9):
    return spark.createDataFrame(
        [(f"t{i}", T0 - dt.timedelta(days=i % days, minutes=i), f"text {i}") for i in range(start, start + n)], SCHEMA)


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def _files(path):
    """Data files by name, with a digest of their bytes."""
    return {f: hashlib.md5(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def _spoil(path, but=()):
    """Make every data file unreadable, except those of some dates."""
    for f in _files(path):
        if not any(f"created_date={d}" in f for d in but):
            open(f, "wb").write(b"no parquet")


def test_delete_rewrites_only_the_dates_it_hits(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 40), path)
    before = _files(path)
    assert len(before) == 9                         # one file for a date, however many tasks
    kept = SK.delete_from(spark, path, F.col("id") == "t13")
    assert _ids(kept) == sorted(f"t{i}" for i in range(40) if i != 13)
    after = _files(path)
    assert before.items() <= after.items()          # the version before stays readable
    new = set(after) - set(before)
    day = str((T0 - dt.timedelta(days=13 % 9, minutes=13)).date())
    assert len(new) == 1 and f"created_date={day}" in new.pop()
    live = {s.date: s.commit for s in V.head(spark, path).segments}
    assert len(set(live.values())) == 2 and len([c for c in live.values() if c != live[day]]) == 8
    SK.delete_from(spark, path, F.col("id") == "t14")
    SK.delete_from(spark, path, F.col("id") == "t15")      # two versions on: t13's old file goes
    assert sum(day in f for f in _files(path)) == 1


def test_delete_of_all_rows_of_a_date_and_of_all_rows(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 18), path)
    day = T0.date() - dt.timedelta(days=1)
    assert SK.delete_from(spark, path, F.to_date("created_at") == F.lit(day)).count() == 16
    assert str(day) not in {s.date for s in V.head(spark, path).segments}
    assert SK.delete_from(spark, path, F.lit(True)).count() == 0
    assert read_table(spark, path).columns == [*COLS, "created_date"]
    assert SK.delete_from(spark, path, F.lit(True)).count() == 0
    SK.append(_df(spark, 3), path)
    assert read_table(spark, path).count() == 3


def test_lookup_by_id_skips_row_groups(spark, tmp):
    path = os.path.join(tmp, "t")
    df = spark.range(40_000).select(F.concat(F.lit("t"), F.md5(F.col("id").cast("string"))).alias("id"),
                                    F.lit(T0).cast("timestamp_ntz").alias("created_at"),
                                    F.md5(F.concat("id", F.lit("x"))).alias("content"))
    try:
        spark.conf.set("parquet.block.size", str(128 * 1024))
        SK.append(df, path)
    finally:
        spark.conf.unset("parquet.block.size")
    one = df.first().id
    got = read_table(spark, path).where(F.col("id") == one).select("id", "content")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = read_table(spark, path).where(F.col("id") == one).select("id", "content")
        plan = got._jdf.queryExecution().executedPlan()
        rows = got._jdf.queryExecution().executedPlan().executeCollect()
        read = int(plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(rows) == 1 and 0 < read < 10_000
    assert SK.delete_from(spark, path, F.col("id") == one).count() == 39_999


def test_expiry_reads_only_the_date_of_the_cutoff(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 45), path)
    clock = T0 - dt.timedelta(minutes=20)                       # some rows of the cut-off's date are old enough
    want = _ids(SK.expire(_df(spark, 45), 3 * 24 * 3600 * 1000, clock))
    edge = str(T0.date() - dt.timedelta(days=3))
    before = _files(path)
    _spoil(path, [edge])
    spoilt = _files(path)
    SK.expire_table(spark, path, 3 * 24 * 3600 * 1000, clock)
    live = V.head(spark, path).segments
    assert min(s.date for s in live) == edge and sum(s.rows for s in live) == len(want)
    for f in before:                                            # later dates: the same files as before
        if f.split("created_date=")[1][:10] > edge:
            assert _files(path)[f] == spoilt[f]
    assert len({s.commit for s in live}) == 2 and len(want) == 17
    SK.expire_table(spark, path, None, T0)
    SK.expire_table(spark, path, 0, T0 + dt.timedelta(days=400))        # all are old: no file is opened
    assert read_table(spark, path).count() == 0
    again = os.path.join(tmp, "u")
    SK.append(_df(spark, 45), again)
    assert _ids(SK.expire_table(spark, again, 3 * 24 * 3600 * 1000, clock)) == want


def test_profile_opens_no_data_file(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 12), path)
    first = SK.table_profile(spark, path).collect()[0]
    SK.append(_df(spark, 8, start=12), path)
    SK.replace(_df(spark, 5), path, TRANSCRIPTS)
    size = sum(os.path.getsize(f) for f in glob.glob(f"{path}/commit={V.head(spark, path).segments[0].commit}/**/*.parquet", recursive=True))
    _spoil(path)
    r = SK.table_profile(spark, path).collect()[0]
    assert (r.num_rows, r.num_files, r.field_names) == (5, 5, "id,created_at,content")
    assert r.num_bytes == size and r.created == first.created < r.modified


def test_readers_see_the_old_rows_or_the_new(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.replace(_df(spark, 10), path, TRANSCRIPTS)
    seen, stop, failed = set(), threading.Event(), []

    def poll():
        while not stop.is_set():
            try:
                seen.add(read_table(spark, path).count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)
                return

    reader = threading.Thread(target=poll)
    reader.start()
    for k in range(6):
        SK.replace(_df(spark, 20 if k % 2 == 0 else 10), path, TRANSCRIPTS)
    stop.set()
    reader.join()
    assert not failed and seen <= {10, 20} and seen


def test_writers_build_on_each_other_or_fail(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 9), path)
    threads = [threading.Thread(target=SK.append, args=(_df(spark, 5, start=100 * k), path)) for k in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert read_table(spark, path).count() == 29
    old = V.head(spark, path).segments[0].key
    V.change(spark, path, [], {old})
    with pytest.raises(V.Conflict):
        V.change(spark, path, [], {old})            # gone already
    assert len(V.head(spark, path).segments) == len({s.key for s in V.head(spark, path).segments})


def test_compaction_bounds_files(spark, tmp):
    path = os.path.join(tmp, "t")
    for k in range(25):
        SK.append(_df(spark, 6, start=6 * k, days=3).repartition(3), path, cluster=False)
    dates = {s.date for s in V.head(spark, path).segments}
    assert SK.table_profile(spark, path).first().num_files > 100
    assert SK.compact(spark, path) == len(dates)
    p = SK.table_profile(spark, path).first()
    assert p.num_files == len(dates) and p.num_rows == 150
    assert _ids(read_table(spark, path)) == sorted(f"t{i}" for i in range(150))
    number = V.head(spark, path).number
    assert SK.compact(spark, path) == 0 and V.head(spark, path).number == number
    SK.append(_df(spark, 1, start=500, days=3), path)           # only the date written again is merged
    before = _files(path)
    assert SK.compact(spark, path) == 1 and len(set(_files(path)) - set(before)) == 1


def test_upload_is_read_once(spark, tmp):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noticed(x):
        seen.add(1)
        return x

    path = os.path.join(tmp, "t")
    raw = spark.createDataFrame([(f"r{i}", "2024-01-01 10:00:00", "x") for i in range(50)], RAW_TRANSCRIPTS)
    bad = SK.checked_append(raw.withColumn("content", noticed("content")), path)
    assert seen.value == 50 and bad.count() == 0 and bad.columns[-1] == "errors" and seen.value == 50
    late = raw.union(spark.createDataFrame([("z", "2024-01-01 10:00:00", None)], RAW_TRANSCRIPTS))
    refused = SK.checked_append(late, path)
    assert [r.errors for r in refused.collect()] == ["content: REQUIRED"]
    assert read_table(spark, path).count() == 50 and len(glob.glob(f"{path}/commit=*")) == 1


def test_empty_window_is_known_without_data(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 18), path)
    assert _ids(recent_or_sample(spark, path, 3, T0)) == _ids(_df(spark, 18).where(F.col("created_at") >= F.lit(T0 - dt.timedelta(days=3))))
    edge = T0 + dt.timedelta(days=7)                            # the newest row lies exactly on the bound
    assert _ids(recent_or_sample(spark, path, 7, edge)) == ["t0"]
    late = recent_or_sample(spark, path, 7, edge + dt.timedelta(microseconds=1))
    _spoil(path)
    assert _ids(late) == [f"ml-test-{i}" for i in range(5)]
    none = os.path.join(tmp, "n")
    SK.append(_df(spark, 0), none)
    assert recent_or_sample(spark, none, 7, T0).count() == 5


def test_history_opens_only_runs_of_its_days(spark, tmp):
    path = os.path.join(tmp, "p")
    for d in (0, 3, 10):
        run = _df(spark, 10).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in PROCESSED.fields[3:-1]],
                                    F.lit(T0 - dt.timedelta(days=d)).cast("timestamp_ntz").alias("processing_timestamp"))
        SK.append(run, path, PROCESSED)
    old = V.head(spark, path).segments[-1].commit
    lower = T0 - dt.timedelta(days=7)
    table = read_table(spark, path, PROCESSED, {"processing_timestamp": lower})
    assert table.inputFiles() and not any(old in f for f in table.inputFiles())
    rows = processing_history(table, T0, 7).collect()
    assert [r.transcripts_processed for r in rows] == [10, 10]


def test_plain_folders_become_versioned_when_rows_go(spark, tmp):
    path = os.path.join(tmp, "t")
    _df(spark, 10).withColumn("created_date", F.to_date("created_at")).write.partitionBy("created_date").parquet(path)
    SK.append(_df(spark, 5, start=10), path)
    assert V.head(spark, path) is None and read_table(spark, path).count() == 15
    assert _ids(SK.delete_from(spark, path, F.col("id") == "t3")) == sorted(f"t{i}" for i in range(15) if i != 3)
    assert V.head(spark, path).number == 1 and not glob.glob(f"{path}/created_date=*")
    raw = os.path.join(tmp, "r")                                # no typed time: no dates
    SK.append(spark.createDataFrame([("a", "x", "y"), (None, None, None)], RAW_TRANSCRIPTS), raw, RAW_TRANSCRIPTS)
    assert SK.delete_from(spark, raw, F.col("id") == "a", RAW_TRANSCRIPTS).count() == 1
    assert [s.date for s in V.head(spark, raw).segments] == [None]
