"""Streams equal their batch forms over inputs split into 1, 3 and n files."""

import os

import pytest

from transcript_lake.operators import audit as AU
from transcript_lake.sources import fixtures as FX
from transcript_lake.sources import sinks as SK
from transcript_lake.sources.schemas import TRANSCRIPTS
from transcript_lake.sources.tables import read_table
from transcript_lake.streaming.ingest import ingest_error_rows, start_ingest
from transcript_lake.streaming.suspicious import suspicious_stream
from conftest import SMALL


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ingest_stream_equals_batch(spark, tmp, parts):
    raw = FX.dirty_rows(spark, SMALL)
    src = os.path.join(tmp, "in")
    raw.repartition(parts).write.parquet(src)
    table, errors = os.path.join(tmp, "table"), os.path.join(tmp, "errors")
    q = start_ingest(spark, src, table, errors, os.path.join(tmp, "ckpt"), available_now=True)
    q.awaitTermination(300)
    good, bad = SK.validate(raw, TRANSCRIPTS)
    got = read_table(spark, table).select(TRANSCRIPTS.fieldNames())
    assert sorted(got.collect()) == sorted(good.collect())
    got_bad = ingest_error_rows(spark, errors).select(bad.columns)
    assert sorted(got_bad.collect(), key=repr) == sorted(bad.collect(), key=repr)


def test_ingest_batch_replay_is_idempotent(spark, tmp):
    from transcript_lake.streaming.ingest import batch_writer
    raw = FX.dirty_rows(spark, SMALL)
    table, errors = os.path.join(tmp, "table"), os.path.join(tmp, "errors")
    write = batch_writer(table, errors)
    write(raw, 0)
    write(raw, 0)          # the same batch again after a failure
    write(raw.limit(10), 1)
    good, bad = SK.validate(raw, TRANSCRIPTS)
    more, worse = SK.validate(raw.limit(10), TRANSCRIPTS)
    SK.compact(spark, table)                # merging forgets the batch's files, not the batch
    write(raw, 0)
    write(raw.limit(10), 1)
    assert read_table(spark, table).count() == good.count() + more.count()
    assert ingest_error_rows(spark, errors).count() == bad.count() + worse.count()


def test_batch_that_reached_one_table_only_is_finished(spark, tmp):
    from transcript_lake.streaming.ingest import ERROR_ROWS, batch_writer
    raw = FX.dirty_rows(spark, SMALL)
    good, bad = SK.validate(raw, TRANSCRIPTS)
    table, errors = os.path.join(tmp, "table"), os.path.join(tmp, "errors")
    SK.append_batch(good, table, TRANSCRIPTS, "ingest", 0)          # then the driver was lost
    batch_writer(table, errors)(raw, 0)
    assert read_table(spark, table).count() == good.count()
    assert read_table(spark, errors, ERROR_ROWS).count() == bad.count()


def test_many_batches_leave_few_files(spark, tmp):
    import datetime as dt
    from transcript_lake.sources import versions as V
    path, day = os.path.join(tmp, "t"), dt.datetime(2024, 1, 1)
    for k in range(30):
        rows = spark.createDataFrame([(f"b{k}r{i}", day + dt.timedelta(days=i, seconds=k), "x") for i in range(2)],
                                     TRANSCRIPTS)
        SK.append_batch(rows, path, TRANSCRIPTS, "s", k, merge_at=4)
        assert len(V.head(spark, path).segments) <= 2 * 5
    assert read_table(spark, path).count() == 60 and SK.table_profile(spark, path).first().num_files <= 10


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_suspicious_stream_equals_batch(spark, tmp, parts):
    entries = FX.audit_json(spark, SMALL)
    src = os.path.join(tmp, "audit")
    entries.repartition(parts).write.text(src)
    stream = suspicious_stream(spark, src, "u1@x.com", window="1 hour", watermark="1 hour",
                               max_files_per_trigger=1)
    name = f"susp_{parts}"
    q = (stream.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(tmp, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.table(name).collect())
    want = sorted(tuple(r) for r in AU.suspicious_counts(
        AU.parse_audit(entries), "u1@x.com", "1 hour").collect())
    assert got == want and len(want) > 0


def test_suspicious_append_writes_closed_windows(spark, tmp):
    from transcript_lake.streaming.suspicious import start_suspicious
    entries = FX.audit_json(spark, SMALL)
    src = os.path.join(tmp, "audit")
    entries.repartition(4).write.text(src)
    out = os.path.join(tmp, "out")
    q = start_suspicious(spark, src, out, os.path.join(tmp, "ckpt"), "u1@x.com",
                         window="1 hour", watermark="1 hour", available_now=True)
    q.awaitTermination(300)
    batch = AU.suspicious_counts(AU.parse_audit(entries), "u1@x.com", "1 hour")
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in batch.collect())
    # every written window is final and equal to the batch count; only windows
    # the watermark has not passed yet are still open
    assert set(got) <= set(want) and len(got) > 0
    latest = max(r[1] for r in want)
    assert all(r in got for r in want if r[1] <= latest - __import__("datetime").timedelta(hours=2))


def test_late_entries_behind_the_watermark_are_dropped(spark, tmp):
    """Spark filters late rows against the previous micro-batch's watermark:
    a row arriving two batches after the watermark passed its window is
    dropped, and its window is not reopened."""
    import json
    src = os.path.join(tmp, "audit")
    os.makedirs(src)

    def entry(i, ts):
        return json.dumps({"insertId": str(i), "timestamp": ts,
                           "protoPayload": {"methodName": "GenerateAccessToken",
                                            "request": {"name": "projects/-/serviceAccounts/sa1"},
                                            "authenticationInfo": {"principalEmail": "eve@x.com"}}})
    files = [("a.json", [entry(1, "2024-01-01 10:00:00"), entry(2, "2024-01-01 12:00:00")]),
             ("b.json", [entry(3, "2024-01-01 12:00:20")]),
             ("c.json", [entry(4, "2024-01-01 10:00:30"), entry(5, "2024-01-01 12:00:40")])]
    for i, (name, lines) in enumerate(files):
        path = os.path.join(src, name)
        with open(path, "w") as f:
            f.write("\n".join(lines) + "\n")
        os.utime(path, (1000 + i, 1000 + i))            # arrival order
    stream = suspicious_stream(spark, src, "u1@x.com", window="1 minute", watermark="30 minutes",
                               max_files_per_trigger=1)
    name = "late_counts"
    q = (stream.writeStream.outputMode("update").format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(tmp, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    dropped = sum(o.get("numRowsDroppedByWatermark", 0)
                  for p in q.recentProgress for o in p["stateOperators"])
    got = {}
    for r in spark.table(name).collect():
        k = r.window_start.strftime("%H:%M")
        got[k] = max(got.get(k, 0), r.suspicious_count)
    assert got == {"10:00": 1, "12:00": 3}
    assert dropped == 1


def test_count_log_loses_no_entry(spark, tmp):
    """Late and unreadable entries over several micro-batches, with merges in between: counted + errors = all."""
    import json
    from transcript_lake.streaming.suspicious import audit_error_rows, count_log, current_counts, start_suspicious_updates
    src = os.path.join(tmp, "audit")
    os.makedirs(src)

    def entry(ts, caller="eve@x.com"):
        return json.dumps({"insertId": "1", "timestamp": ts,
                           "protoPayload": {"methodName": "GenerateAccessToken", "request": {"name": "sa"},
                                            "authenticationInfo": {"principalEmail": caller}}})
    files = [[entry("2024-01-01T10:00:00Z"), entry("2024-01-01T12:00:00Z"), "broken", entry("2024-01-01T12:00:00Z", "u1@x.com")],
             [entry("2024-01-01T12:00:20Z"), entry("noon")],
             [entry("2024-01-01T15:00:30+05:00"), entry("2024-01-01T11:45:00Z"), entry("2024-01-01T12:00:40Z")],
             [entry("2024-01-01T10:00:59Z")], ["", entry("2024-01-01T13:00:00Z")], [entry("2024-01-01T12:00:01Z")]]
    for i, lines in enumerate(files):
        path = os.path.join(src, f"{i}.json")
        with open(path, "w") as f:
            f.write("\n".join(lines) + "\n")
        os.utime(path, (1000 + i, 1000 + i))            # arrival order
    log, errors = os.path.join(tmp, "log"), os.path.join(tmp, "errors")
    start = lambda: start_suspicious_updates(
        spark, src, log, os.path.join(tmp, "ckpt"), "u1@x.com", "1 minute", "30 minutes", available_now=True,
        error_path=errors, max_files_per_trigger=1, merge_at=3)
    q = start()
    q.awaitTermination(300)
    assert q.exception() is None
    got = {r.window_start.strftime("%H:%M"): (r.suspicious_count, r.late_count) for r in count_log(spark, log).collect()}
    # 12:00 was closed by the entry of 13:00; 11:45 came within 30 minutes of 12:00:20
    assert got == {"10:00": (3, 2), "11:45": (1, 0), "12:00": (4, 1), "13:00": (1, 0)}
    assert sorted(r.errors for r in audit_error_rows(spark, errors).collect()) == [
        "entry: malformed", "entry: malformed", "timestamp: invalid"]
    counted = sum(r.suspicious_count for r in current_counts(spark, log).collect())
    assert counted + 3 + 1 == sum(map(len, files))      # three errors, one expected caller
    start().awaitTermination(300)                       # nothing new: nothing changes
    assert sum(r.suspicious_count for r in current_counts(spark, log).collect()) == counted


def test_quiet_update_log_has_no_counts(spark, tmp):
    from transcript_lake.streaming.suspicious import current_counts

    os.makedirs(f"{tmp}/log")
    got = current_counts(spark, f"{tmp}/log")
    assert got.count() == 0 and got.schema["window_start"].dataType.simpleString() == "timestamp_ntz"
