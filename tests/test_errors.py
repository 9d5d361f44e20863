"""Entries and documents that cannot be read are reported and counted, never lost."""

import datetime as dt

import pytest

from transcript_lake.functions.time import utc_time
from transcript_lake.operators import audit as AU
from transcript_lake.operators import policies as PO

T0 = dt.datetime(2024, 1, 30, 10, 0, 0)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_log_times_are_utc_in_any_session_zone(spark, zone):
    want = {
        "2024-01-30T10:00:00Z": T0, "2024-01-30 10:00:00": T0, "2024-01-30T15:00:00+05:00": T0,
        "2024-01-30T04:30:00-05:30": T0, "2024-01-30T10:00:00.123456Z": T0.replace(microsecond=123456),
        "2024-01-30T10:00:00.123456789Z": T0.replace(microsecond=123456),
        "2024-11-03T01:30:00-04:00": dt.datetime(2024, 11, 3, 5, 30), "2024-11-03T01:30:00-05:00": dt.datetime(2024, 11, 3, 6, 30),
        "1969-12-31T23:59:59.5Z": dt.datetime(1969, 12, 31, 23, 59, 59, 500000),
        "yesterday": None, "2024-01-30": None, "2024-02-30T10:00:00Z": None, "2024-01-30T25:00:00Z": None,
        "2024-01-30T10:00:00 UTC": None, "": None, None: None,
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(t,) for t in want], "t string")
        assert {r.t: r.ts for r in df.select("t", utc_time(df.t).alias("ts")).collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def _entry(i, time, method=AU.ACCESS_TOKEN):
    return (f'{{"insertId":"{i}","timestamp":{time},"protoPayload":{{"methodName":"{method}",'
            f'"request":{{"name":"x/serviceAccounts/sa1"}},"authenticationInfo":{{"principalEmail":"eve@x.com"}}}}}}')


def test_every_entry_is_good_or_an_error(spark):
    entries = [_entry(1, '"2024-01-30T10:00:00Z"'), _entry(2, '"2024-01-30T15:00:00+05:00"'), _entry(3, '"soon"'),
               _entry(4, "null"), _entry(5, '"2024-01-30T10:00:00Z"')[:60], "not json", "[1]", "", None,
               '{"insertId":"6","timestamp":"2024-01-30T10:00:00Z","protoPayload":"text"}',
               '{"insertId":"7","timestamp":"2024-01-30T10:00:00Z","other":[1]}']
    df = spark.createDataFrame([(e,) for e in entries], "entry string")
    good, bad = AU.split_audit(df)
    assert good.columns == AU.AUDIT_COLUMNS
    rows = {r.insert_id: r for r in good.collect()}
    assert set(rows) == {"1", "2", "7"} and rows["1"].ts == rows["2"].ts == T0 and rows["7"].method is None
    errors = {r.entry: r.errors for r in bad.collect()}
    assert errors[entries[2]] == "timestamp: invalid" and errors[entries[3]] == "timestamp: missing"
    assert errors[None] == "entry: missing"
    assert {errors[e] for e in [*entries[4:8], entries[9]]} == {"entry: malformed"}
    assert len(rows) + len(errors) == len(entries)
    counts = {r.errors: r.rows for r in AU.error_counts(bad).collect()}
    assert sum(counts.values()) == len(errors) and counts["entry: malformed"] == 5
    # offsets count in the right window, and nothing aborts
    (w,) = AU.suspicious_counts(AU.parse_audit(df), "u1@x.com").collect()
    assert (w.window_start, w.suspicious_count) == (T0, 2)
    assert good.limit(0).count() == AU.audit_errors(df.limit(0)).count() == 0


def test_unreadable_policy_is_not_a_missing_role(spark):
    role = PO.WORKLOAD_IDENTITY_ROLE
    docs = spark.createDataFrame(
        [("has", f'{{"bindings":[{{"role":"{role}","members":["user:a"]}}]}}'), ("lacks", '{"bindings":[]}'),
         ("cut", '{"bindings":[{"role":'), ("cut", '{"bindings":[]}'), ("none", None)], "resource string, policy string")
    flat = PO.flatten_policy(docs)
    assert [tuple(r) for r in flat.collect()] == [("has", role, "user:a")]
    assert [r.resource for r in PO.missing_role(docs, flat).collect()] == ["lacks"]
    assert {(r.resource, r.errors) for r in PO.policy_errors(docs).collect()} == {
        ("cut", "policy: malformed"), ("none", "policy: missing")}
