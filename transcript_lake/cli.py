"""Command line entry points, one per job of the source scripts.

    python -m transcript_lake upload   --table PATH --rows PATH [--format parquet|json]
    python -m transcript_lake read     --table PATH
    python -m transcript_lake pipeline --source PATH --dest PATH [--days 30] [--monitor]
    python -m transcript_lake access   --probes PATH
    python -m transcript_lake delete   --table PATH --id ID
    python -m transcript_lake expire   --table PATH --days N
    python -m transcript_lake compact  --table PATH
    python -m transcript_lake audit    --entries PATH --expected EMAIL [--errors PATH]

Every command prints only bounded results (a 5-row preview, 7 days, the
topics, one row per identity and permission); the rows stay on the cluster.
The session comes from the environment (spark-submit or a local master).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import audit as AU
from .operators import features as FE
from .operators import read as RD
from .plans.pipeline import run_pipeline
from .sources import sinks as SK
from .sources.schemas import AUDIT_ERRORS, PROCESSED, RAW_TRANSCRIPTS
from .sources.tables import read_table


def _print_all(df) -> None:
    """Every row, one partition at a time on the driver, and their number."""
    n = 0
    print(" | ".join(df.columns))
    for n, r in enumerate(df.toLocalIterator(), 1):
        print(" | ".join(str(v) for v in r))
    print(f"{n} rows")


def _upload(spark, a) -> int:
    raw = spark.read.schema(RAW_TRANSCRIPTS).format(a.format).load(a.rows)
    bad = SK.checked_append(raw, a.table)
    n = 0
    for n, r in enumerate(bad.toLocalIterator(), 1):        # one partition at a time
        if n == 1:
            print("upload refused:")
        print(f"  {r.id}: {r.errors}")
    if n:
        print(f"{n} bad rows")
        return 1
    print(RD.rows_on_day(read_table(spark, a.table), a.as_of).collect()[0].row_count,
          "rows dated today")
    return 0


def _read(spark, a) -> int:
    t = read_table(spark, a.table)
    RD.preview(t, 5).show(truncate=False)
    RD.daily_stats(t).show(truncate=False)
    SK.table_profile(spark, a.table).show(truncate=False)
    return 0


def _pipeline(spark, a) -> int:
    run_pipeline(spark, a.source, a.dest, a.days, a.as_of).show(truncate=False)
    if a.monitor:
        FE.processing_history(read_table(spark, a.dest, PROCESSED), a.as_of).show(truncate=False)
    return 0


def _access(spark, a) -> int:
    probes = spark.read.parquet(a.probes)
    _print_all(AU.probe_report(probes))
    levels = AU.access_level(probes)
    _print_all(levels)
    return 0 if levels.filter("access_level <> 'NONE'").limit(1).count() else 1


def _delete(spark, a) -> int:
    before = SK.table_profile(spark, a.table).first().num_rows
    SK.delete_from(spark, a.table, F.col("id") == a.id)
    print(before - SK.table_profile(spark, a.table).first().num_rows, "rows deleted")
    return 0


def _expire(spark, a) -> int:
    SK.expire_table(spark, a.table, a.days * 24 * 3600 * 1000, a.as_of)
    print(SK.table_profile(spark, a.table).first().num_rows, "rows kept")
    return 0


def _compact(spark, a) -> int:
    print(SK.compact(spark, a.table), "dates merged")
    return 0


def _audit(spark, a) -> int:
    """Unexpected token requests by hour; unreadable entries are counted and, if asked, written."""
    good, bad = AU.split_audit(spark.read.text(a.entries), "value")
    _print_all(AU.suspicious_counts(good, a.expected, "1 hour").orderBy("window_start"))
    if a.errors:
        SK.append(bad, a.errors, AUDIT_ERRORS)
    counts = AU.error_counts(bad)
    _print_all(counts)
    return 1 if counts.limit(1).count() else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="transcript_lake")
    p.add_argument("--as-of", dest="as_of", default=None, help="clock (UTC DATETIME); default now")
    sub = p.add_subparsers(dest="cmd", required=True)
    u = sub.add_parser("upload")
    u.add_argument("--table", required=True)
    u.add_argument("--rows", required=True)
    u.add_argument("--format", default="parquet")
    r = sub.add_parser("read")
    r.add_argument("--table", required=True)
    pl = sub.add_parser("pipeline")
    pl.add_argument("--source", required=True)
    pl.add_argument("--dest", required=True)
    pl.add_argument("--days", type=int, default=30)
    pl.add_argument("--monitor", action="store_true")
    ac = sub.add_parser("access")
    ac.add_argument("--probes", required=True)
    de = sub.add_parser("delete")
    de.add_argument("--table", required=True)
    de.add_argument("--id", required=True)
    ex = sub.add_parser("expire")
    ex.add_argument("--table", required=True)
    ex.add_argument("--days", type=int, required=True)
    co = sub.add_parser("compact")
    co.add_argument("--table", required=True)
    au = sub.add_parser("audit")
    au.add_argument("--entries", required=True)
    au.add_argument("--expected", required=True)
    au.add_argument("--errors", default=None)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    return {"upload": _upload, "read": _read, "pipeline": _pipeline, "access": _access, "delete": _delete,
            "expire": _expire, "compact": _compact, "audit": _audit}[a.cmd](spark, a)


if __name__ == "__main__":
    sys.exit(main())
