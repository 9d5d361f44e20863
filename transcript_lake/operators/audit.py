"""Audit-log filters and access probes (R8-R11, F5-F7, W2 batch form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.principals import permission_label, quote_regex
from ..functions.time import utc_time
from ..sources.schemas import AUDIT_ENTRY, CORRUPT, PROBE_COLUMNS, with_corrupt

ACCESS_TOKEN = "GenerateAccessToken"
ID_TOKEN = "GenerateIdToken"


AUDIT_COLUMNS = ["insert_id", "ts", "method", "target", "caller"]


def split_audit(entries: DataFrame, col: str = "entry") -> tuple[DataFrame, DataFrame]:
    """JSON log entries -> (good, errors), each entry in exactly one of them.

    ``good`` is (insert_id, ts, method, target, caller); ``ts`` is zone-less UTC,
    offsets converted. A missing path gives NULL (``authenticationInfo`` is
    absent on some entries). ``errors`` is (entry, errors): entries that are null, are
    not JSON of the declared shape, or whose time is missing or no RFC 3339 time.
    Both are one projection over the entries, so they add no shuffle.
    """
    raw = F.col(col)
    e = F.from_json(raw, with_corrupt(AUDIT_ENTRY), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # a generator is computed once, where a projection would be copied into every filter that uses it
    rows = entries.select(raw.alias("entry"), F.explode(F.array(e)).alias("e"))
    rows = rows.select("*", F.explode(F.array(utc_time(F.col("e.timestamp")))).alias("ts"))
    broken = F.col("e").isNull() | F.col(f"e.{CORRUPT}").isNotNull()
    why = (F.when(F.col("entry").isNull(), "entry: missing")
           .when(broken, "entry: malformed")
           .when(F.col("e.timestamp").isNull(), "timestamp: missing")
           .when(F.col("ts").isNull(), "timestamp: invalid"))
    rows = rows.withColumn("errors", why)
    good = rows.where("errors is null").select(
        F.col("e.insertId").alias("insert_id"), "ts",
        F.col("e.protoPayload.methodName").alias("method"),
        F.col("e.protoPayload.request.name").alias("target"),
        F.col("e.protoPayload.authenticationInfo.principalEmail").alias("caller"),
    )
    return good, rows.where("errors is not null").select("entry", "errors")


def parse_audit(entries: DataFrame, col: str = "entry") -> DataFrame:
    """The good entries of ``split_audit``; ``audit_errors`` has the others."""
    return split_audit(entries, col)[0]


def audit_errors(entries: DataFrame, col: str = "entry") -> DataFrame:
    """(entry, errors) of the entries that no filter or counter sees."""
    return split_audit(entries, col)[1]


def error_counts(errors: DataFrame) -> DataFrame:
    """How many error rows there are of each kind (a few rows, pre-aggregated in every task)."""
    return errors.groupBy("errors").agg(F.count(F.lit(1)).alias("rows"))


def audit_methods(audit: DataFrame, methods=(ACCESS_TOKEN, ID_TOKEN)) -> DataFrame:
    """Entries whose method is any of ``methods``."""
    return audit.filter(F.col("method").isin(list(methods)))


def audit_for_target(audit: DataFrame, account: str) -> DataFrame:
    """Access-token requests against one service account: time, caller, target.

    The account is matched unanchored, as the log filter's ``=~`` does, but
    as literal text.
    """
    pattern = "serviceAccounts/" + quote_regex(account)
    return (audit.filter((F.col("method") == ACCESS_TOKEN) & F.col("target").rlike(pattern))
            .select("insert_id", "ts", "caller", "target"))


def audit_unexpected(audit: DataFrame, expected: str) -> DataFrame:
    """Access-token requests by anyone but ``expected`` (``!~``, unanchored).

    An entry without a caller counts as unexpected.
    """
    known = F.coalesce(F.col("caller").rlike(quote_regex(expected)), F.lit(False))
    return audit.filter((F.col("method") == ACCESS_TOKEN) & ~known)


def audit_by_caller(audit: DataFrame, caller: str, n: int = 50) -> DataFrame:
    """The ``n`` newest access-token requests by one caller (a top-k)."""
    return (audit.filter((F.col("method") == ACCESS_TOKEN) & (F.col("caller") == caller))
            .orderBy(F.desc("ts"), F.desc("insert_id"))
            .limit(n))


def suspicious_counts(audit: DataFrame, expected: str, window: str = "1 minute") -> DataFrame:
    """Count of unexpected access-token requests per tumbling window."""
    return (audit_unexpected(audit, expected)
            .groupBy(F.window("ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("suspicious_count"))
            .select(F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"),
                    "suspicious_count"))


def probe_report(probes: DataFrame, id_col: str = "identity") -> DataFrame:
    """Eight probe columns -> one (identity, permission, ok) row each."""
    return (probes.unpivot([id_col], PROBE_COLUMNS, "probe", "ok")
            .select(id_col, permission_label(F.col("probe")).alias("permission"), "ok"))


def access_level(probes: DataFrame, id_col: str = "identity") -> DataFrame:
    """OWNER if update and delete; else WRITER if write and create; else
    READER if read; else NONE. The order of the tests matters."""
    def ok(c):
        return F.coalesce(F.col(c), F.lit(False))
    level = (F.when(ok("can_update_dataset") & ok("can_delete_data"), "OWNER")
             .when(ok("can_write_data") & ok("can_create_table"), "WRITER")
             .when(ok("can_read_data"), "READER")
             .otherwise("NONE"))
    return probes.select(id_col, level.alias("access_level"))

