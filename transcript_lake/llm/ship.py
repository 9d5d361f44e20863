"""Prepares a session for Python workers that handle whole texts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Whole texts are wide rows: Arrow's default of 10,000 to a batch is too many.
ROWS_PER_BATCH = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark's own file transfer, once per application.

    Where the session has Arrow's default batch size, it gets a smaller one.
    """
    sc = spark.sparkContext
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, ROWS_PER_BATCH)
    if sc.applicationId in _done:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    d = tempfile.mkdtemp(prefix="ship-")        # the driver serves the file from here
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = os.path.join(d, f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _done.add(sc.applicationId)
