"""Registered queries: one per operator key, each over the whole test tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
match the SQL oracle of the same key (``plans/oracle.py``). The clock is the
fixture's ``as_of`` (newest transcript), read inside the plan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_count, preview_text
from ..functions.time import days, now_value
from ..operators import audit as AU
from ..operators import features as FE
from ..operators import grants as GR
from ..operators import policies as PO
from ..operators import read as RD
from ..session import new_table_path
from ..sources import fixtures as FX
from ..sources import sinks as SK
from ..sources.schemas import PROCESSED, RAW_TRANSCRIPTS, TRANSCRIPTS
from ..sources.tables import or_sample, read_table, recent_or_sample
from ..streaming.ingest import ingest_error_rows, start_ingest
from ..streaming.suspicious import current_counts, start_suspicious_updates
from .pipeline import run_pipeline

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
RECENT_DAYS = 30
MONITOR_DAYS = 7
RETENTION_MS = 14 * 24 * 3600 * 1000
PREVIEW_ROWS = 5
DELETE_BELOW_CHARS = 100
DELETE_ID = "t7"
EMPTY_AFTER_DAYS = 400
COMPACT_WRITES = 4
TARGET_ACCOUNT = "sa3"
EXPECTED_CALLER = "u1@x.com"
CALLER = "u7@x.com"
CALLER_ROWS = 50
SUSPICIOUS_WINDOW = "1 hour"
SUSPICIOUS_WATERMARK = "1 hour"
MEMBER_PREFIX = "group:g1"
COLS = TRANSCRIPTS.fieldNames()


def _t(spark, sf):
    return FX.transcripts(spark, sf), FX.as_of(spark, sf)


# -- read side ---------------------------------------------------------------

def daily_stats(spark, sf):
    return RD.daily_stats(FX.transcripts_keyed(spark, sf, content_length=F.length("content")))


def transcript_preview(spark, sf):
    measured = FX.transcripts_keyed(spark, sf, content_length=char_count(F.col("content")),
                                    content_preview=preview_text(F.col("content")))
    return RD.preview(measured, PREVIEW_ROWS, order_by="id")


def recent_transcripts(spark, sf):
    t, clock = _t(spark, sf)
    return RD.recent(t, RECENT_DAYS, clock).select(COLS)


def rows_on_day(spark, sf):
    t, clock = _t(spark, sf)
    return RD.rows_on_day(t, clock)


def any_row(spark, sf):
    return RD.any_row(FX.transcripts(spark, sf))


def sample_fallback(spark, sf):
    t, clock = _t(spark, sf)
    return or_sample(RD.recent(t, MONITOR_DAYS, clock), clock)


def sample_fallback_empty(spark, sf):
    """S3 where the window of a stored table has no row: as of long after the newest."""
    t, clock = _t(spark, sf)
    path = new_table_path(spark, "transcripts")
    SK.append(t, path)
    later = now_value(spark, clock + days(EMPTY_AFTER_DAYS))
    return recent_or_sample(spark, path, MONITOR_DAYS, later)


# -- features and pipeline ---------------------------------------------------

def transcript_features(spark, sf):
    t, clock = _t(spark, sf)
    return FE.features(RD.recent(t, RECENT_DAYS, clock), clock)


def topic_summary(spark, sf):
    return FE.topic_summary(FX.processed_runs(spark, sf, text=False))


def processing_history(spark, sf):
    clock = FX.as_of(spark, sf)
    return FE.processing_history(FX.processed_runs(spark, sf, clock), clock, MONITOR_DAYS)


def stored_history(spark, sf):
    """A4 on a table that each run was appended to; runs before the window are not opened."""
    clock = now_value(spark, FX.as_of(spark, sf))
    runs = FX.processed_runs(spark, sf, F.lit(clock))
    path = new_table_path(spark, "transcripts_processed")
    for d in FX.RUN_OFFSETS_DAYS:
        SK.append(runs.where(F.col("processing_timestamp") == F.lit(clock) - days(d)), path, PROCESSED)
    lower = clock - dt.timedelta(days=MONITOR_DAYS)
    table = read_table(spark, path, PROCESSED, {"processing_timestamp": lower})
    return FE.processing_history(table, clock, MONITOR_DAYS)


def pipeline_summary(spark, sf):
    t, clock = _t(spark, sf)
    source = new_table_path(spark, "transcripts")
    SK.append(t, source)
    newest = now_value(spark, clock)
    return run_pipeline(spark, source, new_table_path(spark, "transcripts_processed"), RECENT_DAYS, newest)


# -- table changes -----------------------------------------------------------

def append_rows(spark, sf):
    t, clock = _t(spark, sf)
    path = new_table_path(spark, "transcripts")
    SK.append(t.filter(F.col("created_at") < clock - days(MONITOR_DAYS)), path)
    SK.append(RD.recent(t, MONITOR_DAYS, clock), path)
    return read_table(spark, path).select(COLS)


def replace_processed(spark, sf):
    t, clock = _t(spark, sf)
    path = new_table_path(spark, "transcripts_processed")
    feats = FE.features(RD.recent(t, RECENT_DAYS, clock), clock)
    SK.replace(feats, path, PROCESSED)
    return read_table(spark, path, PROCESSED).select(PROCESSED.fieldNames())


def invalid_rows(spark, sf):
    _, bad = SK.validate(FX.dirty_rows(spark, sf), TRANSCRIPTS)
    return bad.select("id", "created_at", "errors")


def create_as_select(spark, sf):
    t = FX.transcripts(spark, sf)
    return SK.create_as(t, "your_table", new_table_path(spark, "your_table")).select(COLS)


def delete_where(spark, sf):
    path = new_table_path(spark, "uploads")
    SK.append(FX.dirty_rows(spark, sf), path, RAW_TRANSCRIPTS)
    return SK.delete_from(spark, path, F.length("content") < DELETE_BELOW_CHARS, RAW_TRANSCRIPTS)


def delete_by_id(spark, sf):
    path = new_table_path(spark, "transcripts")
    SK.append(FX.transcripts(spark, sf), path)
    return SK.delete_from(spark, path, F.col("id") == DELETE_ID).select(COLS)


def expire_table(spark, sf):
    t, clock = _t(spark, sf)
    path = new_table_path(spark, "transcripts")
    SK.append(t, path)
    return SK.expire_table(spark, path, RETENTION_MS, now_value(spark, clock)).select(COLS)


def compacted_rows(spark, sf):
    """K1 in several writes without clustering, then merged."""
    t = FX.transcripts(spark, sf)
    path = new_table_path(spark, "transcripts")
    for k in range(COMPACT_WRITES):
        SK.append(t.where(F.pmod(F.xxhash64("id"), F.lit(COMPACT_WRITES)) == k), path, cluster=False)
    SK.compact(spark, path)
    return read_table(spark, path).select(COLS)


def ingest_errors(spark, sf):
    """W1's error table."""
    return _ingest(spark, sf)[1]


def ingest_stream(spark, sf):
    """W1 as a stream: uploads land as files, the stream validates them, good
    rows go to the landing table and bad rows to an error table."""
    return _ingest(spark, sf)[0]


def _ingest(spark, sf):
    src = new_table_path(spark, "uploads_landing")
    FX.dirty_rows(spark, sf).write.parquet(src)
    table, errors = new_table_path(spark, "transcripts_landing"), new_table_path(spark, "upload_errors")
    q = start_ingest(spark, src, table, errors, new_table_path(spark, "ingest_ckpt"), available_now=True)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return read_table(spark, table).select(COLS), ingest_error_rows(spark, errors)


def retention(spark, sf):
    t, clock = _t(spark, sf)
    return SK.expire(t, RETENTION_MS, clock).select(COLS)


def table_profile(spark, sf):
    path = new_table_path(spark, "transcripts")
    SK.append(FX.transcripts(spark, sf), path)
    return SK.table_profile(spark, path).select("num_rows", "field_names")


# -- grants ------------------------------------------------------------------

def all_users(spark, sf):
    return GR.all_users(FX.access_lists(spark, sf))


def normalize_principals(spark, sf):
    return GR.normalize_principals(FX.access_lists(spark, sf))


def expand_grants(spark, sf):
    return GR.expand_grants(FX.access_lists(spark, sf), FX.ACCESS)


def log_viewers(spark, sf):
    return GR.log_viewers(FX.access_lists(spark, sf))


def grant_summary(spark, sf):
    return GR.grant_summary(FX.access_lists(spark, sf), FX.ACCESS)


def invalid_members(spark, sf):
    return GR.invalid_members(PO.flatten_policy(FX.policies(spark, sf)))


# -- policies ----------------------------------------------------------------

def _flat(spark, sf):
    return PO.flatten_policy(FX.policies(spark, sf))


def flatten_policy(spark, sf):
    return _flat(spark, sf)


def members_with_role(spark, sf):
    return PO.members_with_role(_flat(spark, sf))


def policy_has_member(spark, sf):
    return PO.policy_has_member(FX.policies(spark, sf), MEMBER_PREFIX)


def stale_bindings(spark, sf):
    return PO.stale_bindings(_flat(spark, sf), FX.stale_pairs(spark, sf))


def remove_bindings(spark, sf):
    return PO.remove_bindings(_flat(spark, sf), FX.stale_pairs(spark, sf))


def ensure_bindings(spark, sf):
    return PO.ensure_bindings(_flat(spark, sf), FX.wanted_bindings(spark, sf))


def missing_role(spark, sf):
    return PO.missing_role(FX.policies(spark, sf), _flat(spark, sf))


def members_like(spark, sf):
    return PO.members_like(_flat(spark, sf), MEMBER_PREFIX)


def policy_errors(spark, sf):
    return PO.policy_errors(FX.policies_dirty(spark, sf))


def missing_role_known(spark, sf):
    """J2 where some documents cannot be read."""
    docs = FX.policies_dirty(spark, sf)
    return PO.missing_role(docs, PO.flatten_policy(docs))


def repo_mismatch(spark, sf):
    return PO.repo_mismatch(_flat(spark, sf), FX.providers(spark, sf))


# -- audit and probes --------------------------------------------------------

def _audit(spark, sf):
    return AU.parse_audit(FX.audit_json(spark, sf))


def audit_methods(spark, sf):
    return AU.audit_methods(_audit(spark, sf))


def audit_for_target(spark, sf):
    return AU.audit_for_target(_audit(spark, sf), TARGET_ACCOUNT)


def audit_unexpected(spark, sf):
    return AU.audit_unexpected(_audit(spark, sf), EXPECTED_CALLER)


def audit_by_caller(spark, sf):
    return AU.audit_by_caller(_audit(spark, sf), CALLER, CALLER_ROWS)


def audit_errors(spark, sf):
    return AU.audit_errors(FX.audit_dirty(spark, sf))


def audit_error_counts(spark, sf):
    return AU.error_counts(AU.audit_errors(FX.audit_dirty(spark, sf)))


def audit_clean(spark, sf):
    return AU.parse_audit(FX.audit_dirty(spark, sf))


def suspicious_counts(spark, sf):
    return AU.suspicious_counts(_audit(spark, sf), EXPECTED_CALLER, SUSPICIOUS_WINDOW)


def suspicious_stream(spark, sf):
    """W2 as a stream: audit entries land as text files, the counter runs in
    update mode into an update log, the result is the compacted log."""
    src = new_table_path(spark, "audit_landing")
    FX.audit_json(spark, sf).write.text(src)
    log = new_table_path(spark, "suspicious_log")
    q = start_suspicious_updates(spark, src, log, new_table_path(spark, "suspicious_ckpt"),
                                 EXPECTED_CALLER, SUSPICIOUS_WINDOW, SUSPICIOUS_WATERMARK,
                                 available_now=True)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return current_counts(spark, log)


def probe_report(spark, sf):
    return AU.probe_report(FX.probes(spark, sf))


def access_level(spark, sf):
    return AU.access_level(FX.probes(spark, sf))


QUERIES: dict[str, Query] = {f.__name__: f for f in [
    daily_stats, transcript_preview, recent_transcripts, rows_on_day, any_row, sample_fallback,
    sample_fallback_empty,
    transcript_features, topic_summary, processing_history, stored_history, pipeline_summary,
    append_rows, replace_processed, invalid_rows, ingest_stream, ingest_errors, create_as_select, delete_where,
    delete_by_id, compacted_rows, retention, expire_table,
    table_profile,
    all_users, normalize_principals, expand_grants, log_viewers, grant_summary, invalid_members,
    flatten_policy, members_with_role, policy_has_member, stale_bindings, remove_bindings,
    ensure_bindings, missing_role, repo_mismatch, members_like, policy_errors, missing_role_known,
    audit_errors, audit_error_counts, audit_clean, audit_methods, audit_for_target, audit_unexpected, audit_by_caller, suspicious_counts,
    suspicious_stream, probe_report, access_level,
]}
