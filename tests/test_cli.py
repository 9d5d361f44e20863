"""The command line jobs end to end on small tables."""

import os

from transcript_lake.cli import main
from transcript_lake.sources import fixtures as FX
from transcript_lake.sources import sinks as SK
from conftest import SMALL

AS_OF = "2024-01-30 23:59:59"


def test_cli_jobs(spark, tmp, capsys):
    table = os.path.join(tmp, "transcripts")
    SK.append(FX.transcripts(spark, SMALL), table)
    assert main(["--as-of", AS_OF, "read", "--table", table], spark) == 0
    out = capsys.readouterr().out
    assert "content_preview" in out and "transcript_count" in out and "num_rows" in out

    dest = os.path.join(tmp, "processed")
    assert main(["--as-of", AS_OF, "pipeline", "--source", table, "--dest", dest, "--monitor"], spark) == 0
    out = capsys.readouterr().out
    assert "predicted_topic" in out and "transcripts_processed" in out

    rows = os.path.join(tmp, "rows")
    FX.dirty_rows(spark, SMALL).write.parquet(rows)
    assert main(["--as-of", AS_OF, "upload", "--table", table, "--rows", rows], spark) == 1
    assert "upload refused" in capsys.readouterr().out

    probes = os.path.join(tmp, "probes")
    FX.probes(spark, SMALL).write.parquet(probes)
    assert main(["access", "--probes", probes], spark) == 0
    assert "Can Update Dataset" in capsys.readouterr().out


def test_cli_upload_accepts_clean_rows(spark, tmp, capsys):
    from transcript_lake.sources.tables import upload_batch
    table = os.path.join(tmp, "transcripts")
    rows = os.path.join(tmp, "rows")
    upload_batch(spark, ["A first short note.", "A second, longer note on lakes.", "And a third."], AS_OF).write.parquet(rows)
    assert main(["--as-of", AS_OF, "upload", "--table", table, "--rows", rows], spark) == 0
    assert capsys.readouterr().out.strip().startswith("3 rows dated today")


def test_reports_are_whole(spark, tmp, capsys):
    """More rows than any screenful: every error and every identity is printed, with totals."""
    from pyspark.sql import functions as F

    from transcript_lake.cli import _print_all, main

    spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("2024").alias("created_at"),
                           F.lit("x").alias("content")).write.parquet(f"{tmp}/rows")
    assert main(["upload", "--table", f"{tmp}/t", "--rows", f"{tmp}/rows"], spark) == 1
    out = capsys.readouterr().out
    assert out.count("invalid") == 50 and "50 bad rows" in out
    _print_all(spark.range(300))
    assert "300 rows" in capsys.readouterr().out


def test_cli_table_jobs(spark, tmp, capsys):
    table = os.path.join(tmp, "transcripts")
    SK.append(FX.transcripts(spark, SMALL), table)
    n = SK.table_profile(spark, table).first().num_rows
    assert main(["delete", "--table", table, "--id", "t7"], spark) == 0
    assert main(["delete", "--table", table, "--id", "t7"], spark) == 0
    out = capsys.readouterr().out
    assert "1 rows deleted" in out and "0 rows deleted" in out
    SK.append(FX.transcripts(spark, SMALL).limit(3), table)
    assert main(["compact", "--table", table], spark) == 0
    assert "dates merged" in capsys.readouterr().out
    assert main(["--as-of", AS_OF, "expire", "--table", table, "--days", "7"], spark) == 0
    kept = int(capsys.readouterr().out.split()[0])
    assert 0 < kept < n


def test_cli_audit(spark, tmp, capsys):
    from transcript_lake.streaming.suspicious import audit_error_rows
    entries, errors = os.path.join(tmp, "log"), os.path.join(tmp, "errors")
    FX.audit_dirty(spark, SMALL).write.text(entries)
    assert main(["audit", "--entries", entries, "--expected", "u1@x.com", "--errors", errors], spark) == 1
    assert "entry: malformed" in capsys.readouterr().out
    assert audit_error_rows(spark, errors).count() > 0
    clean = os.path.join(tmp, "clean")
    FX.audit_json(spark, SMALL).write.text(clean)
    assert main(["audit", "--entries", clean, "--expected", "u1@x.com"], spark) == 0
