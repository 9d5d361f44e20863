"""Tables between the steps of a job, in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that no later step reads.

    Shuffle files of the steps that made them go when the driver collects its
    garbage, so it is asked to.
    """
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def apart(df: DataFrame, *results: str) -> DataFrame:
    """``df`` with underscores added to columns that are called like a result (in any case), so both can be returned."""
    taken = {r.lower() for r in results} | {c.lower() for c in df.columns}
    names = {}
    for c in df.columns:
        if c.lower() in {r.lower() for r in results}:
            new = c + "_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            names[c] = new
    return df.withColumnsRenamed(names)
