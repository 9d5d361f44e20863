"""Writes and table changes."""

import datetime as dt
import os

import pytest

from pyspark.sql import functions as F

from transcript_lake.sources import sinks as SK
from transcript_lake.sources.schemas import PROCESSED, RAW_TRANSCRIPTS, TRANSCRIPTS
from transcript_lake.sources.tables import literal_row, read_table, upload_batch

AS_OF = dt.datetime(2024, 3, 31, 12, 0, 0)
SCHEMA = "id string, created_at timestamp_ntz, content string"


def _df(spark, n, start=0):
    return spark.createDataFrame(
        [(f"t{i}", AS_OF - dt.timedelta(days=i % 9, minutes=i), f"text {i}") for i in range(start, start + n)],
        SCHEMA)


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_append_adds_rows(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 10), path)
    SK.append(_df(spark, 5, start=10), path)
    t = read_table(spark, path)
    assert t.count() == 15
    assert "created_date" in t.columns


def test_replace_twice_equals_once(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.replace(_df(spark, 10), path, TRANSCRIPTS)
    SK.replace(_df(spark, 10), path, TRANSCRIPTS)
    assert read_table(spark, path).count() == 10


def test_replace_from_itself(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 10), path)
    src = read_table(spark, path).filter(F.col("id") != "t3").select(TRANSCRIPTS.fieldNames())
    SK.replace(src, path, TRANSCRIPTS)          # detects that it reads its target
    assert read_table(spark, path).count() == 9


def test_replace_casts_to_declared(spark, tmp):
    path = os.path.join(tmp, "p")
    df = spark.createDataFrame([("a", AS_OF, "x y", 2, 3, 1.5, 0.1, 0.9, "general", AS_OF)],
                               "id string, created_at timestamp_ntz, content string, word_count int, "
                               "char_count int, avg_word_length float, sentiment_score double, "
                               "topic_confidence double, predicted_topic string, processing_timestamp timestamp_ntz")
    SK.replace(df, path, PROCESSED)
    got = read_table(spark, path, PROCESSED)
    assert dict(got.dtypes)["word_count"] == "bigint"
    assert dict(got.dtypes)["avg_word_length"] == "double"


def test_delete_null_predicate_keeps_row(spark):
    df = spark.createDataFrame([("a", None), ("b", "x" * 200), ("c", "short")], "id string, content string")
    kept = SK.delete_where(df, F.length("content") < 100)
    assert _ids(kept) == ["a", "b"]
    # NOT pred alone would drop the NULL row too
    assert _ids(df.filter(~(F.length("content") < 100))) == ["b"]


def test_delete_twice_equals_once(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 20), path)
    pred = F.col("id").isin("t1", "t2")
    once = _ids(SK.delete_from(spark, path, pred))
    twice = _ids(SK.delete_from(spark, path, pred))
    assert once == twice and len(once) == 18


def test_validate_routes_rows(spark):
    raw = spark.createDataFrame(
        [("a", "2024-01-01 10:00:00", "ok"), (None, "2024-01-01 10:00:00", "x"),
         ("c", "bad", "x"), ("d", None, None)], RAW_TRANSCRIPTS)
    good, bad = SK.validate(raw, TRANSCRIPTS)
    assert _ids(good) == ["a"]
    assert good.schema["created_at"].dataType == TRANSCRIPTS["created_at"].dataType
    errs = {r.id: r.errors for r in bad.collect()}
    assert errs[None] == "id: REQUIRED"
    assert errs["c"] == "created_at: invalid DATETIME"
    assert errs["d"] == "created_at: REQUIRED; content: REQUIRED"


def test_checked_append_all_or_nothing(spark, tmp):
    path = os.path.join(tmp, "t")
    raw = spark.createDataFrame([("a", "2024-01-01 10:00:00", "ok"), ("b", "bad", "x")], RAW_TRANSCRIPTS)
    bad = SK.checked_append(raw, path)
    assert bad.count() == 1 and not os.path.exists(path)
    SK.checked_append(raw, path, all_or_nothing=False)
    assert _ids(read_table(spark, path)) == ["a"]


def test_upload_batch_then_count_today(spark, tmp):
    from transcript_lake.operators.read import rows_on_day
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 10), path)
    before = rows_on_day(read_table(spark, path), AS_OF).collect()[0].row_count
    batch = upload_batch(spark, ["A first short note.", "A second, longer note on lakes.", "And a third."], AS_OF)
    ids = _ids(batch)
    assert len(set(ids)) == 3
    bad = SK.checked_append(batch, path)
    assert bad.count() == 0
    after = rows_on_day(read_table(spark, path), AS_OF).collect()[0].row_count
    assert after == before + 3


def test_literal_row(spark):
    r = literal_row(spark, "id123", "Your content here", AS_OF).collect()[0]
    assert r.id == "id123" and r.created_at == AS_OF


def test_create_as_replaces(spark, tmp):
    t1 = SK.create_as(_df(spark, 4), "tl_test_table", os.path.join(tmp, "a"))
    assert t1.count() == 4
    t2 = SK.create_as(spark.table("tl_test_table").limit(2), "tl_test_table", os.path.join(tmp, "b"))
    assert t2.count() == 2


def test_expire(spark):
    df = _df(spark, 20)
    assert SK.expire(df, None, AS_OF).count() == 20
    kept = SK.expire(df, 3 * 24 * 3600 * 1000, AS_OF).collect()
    assert all(r.created_at > AS_OF - dt.timedelta(days=3) for r in kept)
    assert 0 < len(kept) < 20


def test_table_profile(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 12), path)
    r = SK.table_profile(spark, path).collect()[0]
    assert r.num_rows == 12 and r.num_bytes > 0 and r.num_files >= 1
    assert r.field_names == "id,created_at,content"
    assert r.created <= r.modified


def test_required_flags():
    from transcript_lake.sources.schemas import required_fields
    assert required_fields(TRANSCRIPTS) == ["id", "created_at", "content"]
    assert required_fields(PROCESSED) == ["id", "created_at", "content"]


def test_named_table_append_replace_delete(spark, tmp):
    name = "tl_named_" + os.path.basename(tmp).replace("-", "_")
    SK.append(_df(spark, 6), name)
    SK.append(_df(spark, 4, start=6), name)
    assert spark.table(name).count() == 10
    kept = SK.delete_from(spark, name, F.col("id").isin("t0", "t9"))
    assert kept.count() == 8
    SK.replace(spark.table(name).filter(F.col("id") != "t1").select(TRANSCRIPTS.fieldNames()),
               name, TRANSCRIPTS)
    assert _ids(spark.table(name)) == sorted(f"t{i}" for i in range(2, 9))


def test_replace_when_only_a_subquery_reads_the_target(spark, tmp):
    a, b = os.path.join(tmp, "a"), os.path.join(tmp, "b")
    SK.append(_df(spark, 20), a)
    SK.append(_df(spark, 20), b)
    clock = read_table(spark, a).select(F.max("created_at")).scalar()
    src = (read_table(spark, b).filter(F.col("created_at") >= clock - F.expr("INTERVAL 3 DAYS"))
           .select(TRANSCRIPTS.fieldNames()))
    want = sorted(r.id for r in src.collect())
    SK.replace(src, a, TRANSCRIPTS)             # the target is read only by the clock
    assert _ids(read_table(spark, a)) == want and want


def test_required_values_are_enforced(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 5), path)
    holes = spark.createDataFrame([("x1", AS_OF, None), (None, AS_OF, "y")], SCHEMA)
    with pytest.raises(Exception, match="REQUIRED"):
        SK.append(holes, path)
    assert read_table(spark, path).count() == 5            # nothing was added
    with pytest.raises(Exception, match="REQUIRED"):
        SK.replace(holes, path, TRANSCRIPTS)
    assert read_table(spark, path).count() == 5            # nothing was removed
    src = read_table(spark, path).select(
        "id", "created_at", F.when(F.col("id") == "t1", None).otherwise(F.col("content")).alias("content"))
    with pytest.raises(Exception, match="REQUIRED"):
        SK.replace(src, path, TRANSCRIPTS)                 # reads its target
    assert read_table(spark, path).count() == 5


def _broken(df):
    """One row of ``df`` raises when it is computed, after others were written."""
    return df.withColumn("content", F.when(F.col("id") == "t7", F.raise_error(F.lit("broken row")))
                         .otherwise(F.col("content")))


def test_failed_replace_keeps_the_old_path(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 9), path)
    with pytest.raises(Exception, match="broken row"):
        SK.replace(_broken(_df(spark, 50)), path, TRANSCRIPTS)
    bad_cast = _df(spark, 3).withColumn("created_at", F.lit("no time"))
    with pytest.raises(Exception):
        SK.replace(bad_cast, path, TRANSCRIPTS)
    assert _ids(read_table(spark, path)) == [f"t{i}" for i in range(9)]
    assert os.listdir(tmp) == ["t"]             # nothing left beside it


def test_replace_from_a_scan_of_two_paths(spark, tmp):
    a, b = os.path.join(tmp, "a"), os.path.join(tmp, "b")
    _df(spark, 20).write.parquet(a)             # flat folders can be read together
    _df(spark, 20, start=20).write.parquet(b)
    clock = spark.read.parquet(b, a).select(F.max("created_at")).scalar()
    src = read_table(spark, b).filter(F.col("created_at") <= clock).select(TRANSCRIPTS.fieldNames())
    SK.replace(src, a, TRANSCRIPTS)
    assert read_table(spark, a).count() == 20 and set(_ids(read_table(spark, a))) == {f"t{i}" for i in range(20, 40)}


def test_failed_writes_keep_the_named_table(spark, tmp):
    name = "tl_kept_" + os.path.basename(tmp).replace("-", "_")
    SK.create_as(_df(spark, 9), name, os.path.join(tmp, "n"))
    with pytest.raises(Exception, match="broken row"):
        SK.create_as(_broken(_df(spark, 50)), name, os.path.join(tmp, "n"))
    with pytest.raises(Exception, match="broken row"):
        SK.replace(_broken(_df(spark, 50)), name, TRANSCRIPTS)
    assert spark.table(name).count() == 9
    SK.create_as(spark.table(name).where("id <> 't0'"), name, os.path.join(tmp, "n"))   # from itself
    assert spark.table(name).count() == 8 and len(os.listdir(os.path.join(tmp, "n"))) == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(name + "__")]


def test_location_column_is_not_the_location(spark, tmp):
    name = "tl_loc_" + os.path.basename(tmp).replace("-", "_")
    SK.create_as(_df(spark, 3).withColumn("Location", F.lit("x")), name, os.path.join(tmp, "n"))
    assert os.path.join(tmp, "n") in SK._table_location(spark, name)


def test_delete_of_nothing_rewrites_nothing(spark, tmp):
    path = os.path.join(tmp, "t")
    SK.append(_df(spark, 9), path)
    files = lambda: sorted(os.path.join(d, n) for d, _, ns in os.walk(path) for n in ns)
    before = files()
    assert SK.delete_from(spark, path, F.col("id") == "none").count() == 9
    assert files() == before
    assert _ids(SK.delete_from(spark, path, F.col("id") == "t3")) == [f"t{i}" for i in range(9) if i != 3]
