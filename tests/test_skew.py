"""A resource holding a third of all bindings: AQE splits it, results stay whole."""

import contextlib
import io

from pyspark.sql import functions as F

from transcript_lake.operators import policies as PO

WIU = PO.WORKLOAD_IDENTITY_ROLE


def test_hot_resource_is_split_and_complete(spark):
    n = 60000
    ids = spark.range(n)
    # one third of all rows on resource "hot", the rest spread over 500 others
    resource = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("r"), (F.col("id") % 500).cast("string")))
    flat = ids.select(resource.alias("resource"), F.lit(WIU).alias("role"),
                      F.concat(F.lit("principalSet://pool/attribute.repository/org/repo-"),
                               (F.col("id") % 7).cast("string")).alias("member"))
    providers = (spark.range(500).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("resource"))
                 .union(spark.range(1).select(F.lit("hot")))
                 .select("resource", F.lit("assertion.repository == 'org/repo-0'").alias("condition")))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = PO.repo_mismatch(flat, providers)
        got = len(out.collect())
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            out.explain()
        final = buf.getvalue()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    want = sum(1 for i in range(n) if i % 7 != 0)
    assert got == want
    # the final adaptive plan split the hot partition
    assert "SortMergeJoin" in final and "skew=true" in final
