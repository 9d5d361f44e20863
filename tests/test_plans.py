"""Physical plan properties that matter at scale."""

import contextlib
import datetime as dt
import io
import os
import re

import pytest

from transcript_lake.operators import read as RD
from transcript_lake.operators.features import features
from transcript_lake.plans.queries import QUERIES
from transcript_lake.sources import fixtures as FX
from transcript_lake.sources import sinks as SK
from transcript_lake.sources.tables import read_table
from conftest import SMALL

AS_OF = dt.datetime(2024, 1, 30)


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def exchange_inputs(p: str) -> list[str]:
    """The Input line of every Exchange node of a formatted plan."""
    lines = p.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines)
            if re.match(r"^\(\d+\) Exchange", line) and i + 1 < len(lines)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = os.path.join(str(tmp_path_factory.mktemp("stored")), "transcripts")
    SK.append(FX.transcripts(spark, SMALL), path)
    return path


def test_window_prunes_date_partitions(spark, stored):
    p = plan(RD.recent(read_table(spark, stored), 7, AS_OF))
    assert "PartitionFilters: [isnotnull(created_date" in p
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in p


def test_daily_stats_aggregates_before_shuffle(spark, stored):
    p = plan(RD.daily_stats(read_table(spark, stored)))
    assert "partial_count" in p and "partial_avg" in p
    assert "TakeOrderedAndProject" in p
    # the wide text column is read but never shuffled
    shuffled = exchange_inputs(p)
    assert shuffled and not any("content" in line for line in shuffled)


def test_features_need_no_shuffle_or_python(spark, stored):
    p = plan(features(read_table(spark, stored), AS_OF))
    assert "Exchange" not in p
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_preview_is_top_k(spark, stored):
    p = plan(RD.preview(read_table(spark, stored), 5, order_by="id"))
    assert "TakeOrderedAndProject" in p


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_pairwise_joins(spark, key):
    if key in {"append_rows", "replace_processed", "create_as_select", "delete_where",
               "table_profile", "pipeline_summary", "suspicious_stream",
               "ingest_stream", "ingest_errors", "delete_by_id", "expire_table", "compacted_rows", "stored_history"}:
        pytest.skip("writes; its read-back plan is a scan")
    p = plan(QUERIES[key](spark, SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p


def test_bucketed_tables_join_without_shuffle(spark, tmp_path_factory):
    from transcript_lake.operators import policies as PO
    base = str(tmp_path_factory.mktemp("bucketed"))
    keys = ["resource", "role", "member"]
    flat = SK.create_as(FX.policy_flat(spark, SMALL), "tl_flat_b", os.path.join(base, "flat"),
                        bucket_by=(8, keys))
    stale = SK.create_as(FX.stale_pairs(spark, SMALL), "tl_stale_b", os.path.join(base, "stale"),
                         bucket_by=(8, keys))
    confs = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {c: spark.conf.get(c, None) for c in confs}
    try:
        for c in confs:
            spark.conf.set(c, "-1")
        out = PO.remove_bindings(flat, stale)       # its lookup-side distinct reuses the buckets
        p = plan(out)
        got = out.count()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert "SortMergeJoin" in p and "Exchange" not in p
    assert got == PO.remove_bindings(FX.policy_flat(spark, SMALL), FX.stale_pairs(spark, SMALL)).count()


def test_day_and_expiry_prune_partitions(spark, stored):
    p = plan(RD.rows_on_day(read_table(spark, stored), AS_OF))
    assert "PartitionFilters: [isnotnull(created_date" in p and "(created_date" in p
    p = plan(SK.expire(read_table(spark, stored), 3 * 24 * 3600 * 1000, AS_OF))
    assert "PartitionFilters: [isnotnull(created_date" in p
    assert "GreaterThan(created_at" in p


def test_required_check_reaches_parquet(spark, stored):
    from functools import reduce
    from pyspark.sql import functions as F
    from transcript_lake.sources.schemas import TRANSCRIPTS
    cond = reduce(lambda a, b: a | b, [F.col(f.name).isNull() for f in TRANSCRIPTS.fields if not f.nullable])
    p = plan(read_table(spark, stored).filter(cond).limit(1))
    assert "PushedFilters: [Or(Or(IsNull(id),IsNull(created_at)),IsNull(content))]" in p


@pytest.mark.parametrize("key", ["daily_stats", "transcript_preview", "topic_summary", "rows_on_day", "any_row"])
def test_no_text_is_shuffled_without_broadcast(spark, key):
    confs = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for c in confs:
            spark.conf.set(c, "-1")
        shuffled = exchange_inputs(plan(QUERIES[key](spark, SMALL)))
    finally:
        for c in confs:
            spark.conf.unset(c)
    assert shuffled and not any(re.search(r"\b(content|text)#", line) for line in shuffled)
