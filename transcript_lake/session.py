"""Session defaults and the shared folder for written tables.

Library functions never create a session; they take the caller's. The helper
below is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_SHARED_CONF = "spark.checkpoint.dir"
_LOCAL_BASE: dict[str, str] = {}


def lake_session(master: str | None = None, cpus: int | None = None,
                 app: str = "transcript-lake", **extra: str) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    UTC session zone (all DATETIME values are zone-less and the streaming
    jobs cast them to TIMESTAMP), AQE on so that join strategy, partition
    count and skewed partitions are decided from real shuffle sizes, and the
    web UI off.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    n = cpus or os.cpu_count() or 8
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(2 * n),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # local runs only: the sf0.1 test tables need far less; keep room on
        # small machines (TRANSCRIPT_LAKE_DRIVER_MEMORY overrides).
        "spark.driver.memory": os.environ.get("TRANSCRIPT_LAKE_DRIVER_MEMORY", "4g"),
    }
    conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    Written tables and checkpoints go below it. When the session names it,
    only the session config is read (works with Spark Connect too). Only when
    it names none (tests, a laptop; never a cluster) is a private folder made,
    once per application, and set as the checkpoint folder.
    """
    base = spark.conf.get(_SHARED_CONF, None)
    if base:
        return base
    sc = spark.sparkContext
    base = sc.getConf().get(_SHARED_CONF, None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder on shared storage: written tables "
                "and checkpoints must be visible to every executor")
        app = sc.applicationId
        base = _LOCAL_BASE.get(app)
        if base is None:
            base = _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="transcript-lake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(os.path.join(base, "checkpoints"))
    return base


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh location for a table under the shared folder."""
    return os.path.join(shared_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")
