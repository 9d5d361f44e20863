"""Table reads, fallback rows and upload batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import as_of_col, days, now_value, ts_text
from ..operators.read import recent
from . import versions as V
from .schemas import PARTITION_COLUMN, TRANSCRIPTS

# The five rows a pipeline run uses when its window is empty.
SAMPLE_CONTENT = [
    "Technical discussion about neural networks and deep learning.",
    "Business meeting notes on Q4 revenue projections.",
    "General team standup discussing project timelines.",
    "Customer support ticket regarding login issues.",
    "Technical deep dive into transformer architecture.",
]
SAMPLE_ID_PREFIX = "ml-test-"


def has_dates(schema: T.StructType) -> bool:
    """Whether written tables of the schema are partitioned by date: it has a typed ``created_at``."""
    return "created_at" in schema.fieldNames() and \
        isinstance(schema["created_at"].dataType, (T.TimestampNTZType, T.TimestampType))


def stored_schema(schema: T.StructType) -> T.StructType:
    """Schema of a written table: the declared fields plus the date partition."""
    if not has_dates(schema):
        return schema
    return T.StructType(schema.fields + [T.StructField(PARTITION_COLUMN, T.DateType(), True)])


def is_partitioned(spark: SparkSession, path: str, column: str = PARTITION_COLUMN) -> bool:
    """Whether the folder's immediate children are ``column=value`` directories."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return True                         # nothing there: let the reader say so
    return any(f.getPath().getName().startswith(f"{column}=") for f in fs.listStatus(hadoop))


def read_table(spark: SparkSession, where: str, schema: T.StructType = TRANSCRIPTS,
               since: dict[str, dt.datetime] | None = None) -> DataFrame:
    """Full scan of a table given by catalog name or path.

    Paths are read with the declared schema, so no file footers are opened
    to infer it; the date partition column comes along for pruning. A versioned
    table is read as of its current version; ``since`` (time column to bound) then leaves
    out files that its version file knows to end before the bound (rows before it may
    remain; filter them). A plain folder written without date partitions
    gets the date column from ``created_at``.
    """
    if "/" not in where:
        return spark.table(where)
    version = V.head(spark, where)
    if version:
        return V.scan(spark, where, V.since(version.segments, since), schema, has_dates(schema)).drop(V.COMMIT)
    stored = stored_schema(schema)
    if stored != schema and not is_partitioned(spark, where):
        return spark.read.schema(schema).parquet(where).withColumn(PARTITION_COLUMN, F.to_date("created_at"))
    return spark.read.schema(stored).parquet(where)


def recent_or_sample(spark: SparkSession, where: str, n_days: int, as_of=None,
                     schema: T.StructType = TRANSCRIPTS) -> DataFrame:
    """The trailing window of a stored table, or the five sample rows when it is empty (F1, S3).

    A versioned table's time bounds say whether the window has a row, so its files
    are read once, by whatever uses the result, and not at all for an empty window.
    """
    version = V.head(spark, where) if "/" in where else None
    lower = now_value(spark, as_of_col(as_of) - days(n_days)) if version else None
    filled = V.any_since(version.segments, "created_at", lower) if version else None
    cols = ["id", "created_at", "content"]
    if filled is None:
        return or_sample(recent(read_table(spark, where, schema), n_days, as_of), as_of)
    if not filled:
        return sample_rows(spark, as_of)
    return recent(read_table(spark, where, schema, {"created_at": lower}), n_days, as_of).select(cols)


def sample_rows(spark: SparkSession, as_of=None) -> DataFrame:
    """The five fallback rows: ``ml-test-i`` dated ``as_of - i`` days."""
    i = F.col("id")
    texts = F.array(*[F.lit(t) for t in SAMPLE_CONTENT])
    return spark.range(len(SAMPLE_CONTENT)).select(
        F.concat(F.lit(SAMPLE_ID_PREFIX), i.cast("string")).alias("id"),
        (as_of_col(as_of) - F.make_dt_interval(days=i.cast("int"))).alias("created_at"),
        F.element_at(texts, (i + 1).cast("int")).alias("content"),
    )


def or_sample(df: DataFrame, as_of=None) -> DataFrame:
    """``df``, or the five sample rows when ``df`` has no row.

    Decided inside the plan by an EXISTS subquery, not on the driver.
    """
    cols = ["id", "created_at", "content"]
    fallback = sample_rows(df.sparkSession, as_of).where(~df.exists())
    return df.select(cols).unionByName(fallback)


def upload_batch(spark: SparkSession, texts: list[str], as_of=None) -> DataFrame:
    """Rows as an uploader sends them: random UUID id, the clock as text."""
    return (spark.createDataFrame([(t,) for t in texts], "content string")
            .select(F.expr("uuid()").alias("id"),
                    ts_text(as_of_col(as_of)).alias("created_at"),
                    "content"))


def literal_row(spark: SparkSession, id_: str, content: str, as_of=None) -> DataFrame:
    """``INSERT ... VALUES (id, CURRENT_DATETIME(), content)`` as a DataFrame."""
    return (spark.createDataFrame([(id_, content)], "id string, content string")
            .select("id", as_of_col(as_of).alias("created_at"), "content"))
