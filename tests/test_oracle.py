"""Every registered query equals its SQL twin (DuckDB) on the small tables."""

import datetime as dt
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from transcript_lake.plans.oracle import oracle_sql
from transcript_lake.plans.queries import QUERIES
from conftest import SMALL

TABLES = ["customer", "supplier", "nation", "events", "documents"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_sql())


def test_entry_registers_the_core_queries():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_entry_without_optional_packages():
    """A package that only the training-data operators need may be absent."""
    code = ("import sys, warnings; sys.modules['ahocorasick'] = None; sys.modules['public_tokenizers'] = None\n"
            "sys.path.insert(0, '.'); warnings.simplefilter('ignore')\n"
            "import __spark_entry__ as e; from transcript_lake.plans.queries import QUERIES\n"
            "assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(oracle_sql()[key])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(df.columns, s_rows) == _rows(d_cols, d_rows)


def test_entry_smoke(spark):
    df = __spark_entry__.entry(spark)
    rows = df.collect()
    assert df.columns == ["date", "transcript_count", "avg_content_length",
                          "earliest_transcript", "latest_transcript"]
    assert 0 < len(rows) <= 7


JOIN_KEYS = ["daily_stats", "transcript_features", "repo_mismatch", "stale_bindings",
             "remove_bindings", "ensure_bindings", "missing_role"]


@pytest.mark.parametrize("key", JOIN_KEYS)
def test_join_queries_without_broadcast(spark, duck, key):
    """Beyond the broadcast size the same queries plan as sort-merge joins
    and give the same rows."""
    import contextlib
    import io
    confs = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {c: spark.conf.get(c, None) for c in confs}
    try:
        for c in confs:
            spark.conf.set(c, "-1")
        df = QUERIES[key](spark, SMALL)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        assert "SortMergeJoin" in buf.getvalue() and "BroadcastHashJoin" not in buf.getvalue()
        s_rows = [tuple(r) for r in df.collect()]
    finally:
        for c, v in before.items():
            if v is None:
                spark.conf.unset(c)
            else:
                spark.conf.set(c, v)
    res = duck.execute(oracle_sql()[key])
    d_cols = [c[0] for c in res.description]
    assert _rows(df.columns, s_rows) == _rows(d_cols, res.fetchall())
