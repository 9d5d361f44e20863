"""Writes and table changes.

A table is a folder or a catalog name. Folders are versioned (``versions``):
every change writes new files beside the old ones and becomes visible by one
rename of a small version file, so a failed job leaves the table as it was and
a reader never meets a gap. Deletes and expiry rewrite only the dates they
touch. A plain Parquet folder made elsewhere is read as it is, appends to it stay
plain, and the first change that replaces rows makes it a versioned table. Names
belong to the session catalog: a new version is written in full, then the name moves to it.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import as_of_col, millis, now_value
from ..operators.read import prune_dates
from ..session import new_table_path, shared_dir
from . import versions as V
from .schemas import PARTITION_COLUMN, TRANSCRIPTS
from .tables import has_dates, read_table

_TYPE_NAMES = {
    T.StringType(): "STRING", T.TimestampNTZType(): "DATETIME", T.LongType(): "INTEGER",
    T.DoubleType(): "FLOAT", T.BooleanType(): "BOOLEAN", T.DateType(): "DATE",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast to the declared types, in declared order."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _required_missing(schema: T.StructType):
    """(field, predicate) pairs that are TRUE where a REQUIRED value is missing."""
    return [(f.name, F.col(f.name).isNull()) for f in schema.fields if not f.nullable]


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail the job on a missing REQUIRED value (files do not keep NOT NULL).

    The check rides along in the write itself: a task that meets a NULL
    raises, the job aborts and nothing is committed.
    """
    guarded = {name: F.when(miss, F.raise_error(F.lit(f"{name}: REQUIRED"))).otherwise(F.col(name))
               for name, miss in _required_missing(schema)}
    return df.select([guarded.get(c, F.col(c)).alias(c) for c in df.columns])


def _with_partition(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the date partition column when the table has a typed created_at."""
    types = dict(df.dtypes)
    if types.get("created_at") in ("timestamp_ntz", "timestamp"):
        return df.withColumn(PARTITION_COLUMN, F.to_date("created_at")), [PARTITION_COLUMN]
    return df, []


#: Fixed value: the form of an uploaded time, ``%Y-%m-%d %H:%M:%S``.
UPLOAD_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def _checked(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """The typed columns, the raw ones as ``_raw_*`` and the messages of each row as ``_errors``."""
    typed, checks = [], []
    for f in schema.fields:
        src = F.col(f.name)
        same = raw.schema[f.name].dataType == f.dataType
        val = src if same else src.try_cast(f.dataType)
        if not same and f.dataType == T.TimestampNTZType() and raw.schema[f.name].dataType == T.StringType():
            val = F.when(src.rlike(UPLOAD_TIME), val)       # no zones, no partial dates
        typed.append(val.alias(f.name))
        if not f.nullable:
            checks.append(F.when(src.isNull(), F.lit(f"{f.name}: REQUIRED")))
        if not same:
            name = _TYPE_NAMES.get(f.dataType, f.dataType.simpleString())
            checks.append(F.when(src.isNotNull() & val.isNull(), F.lit(f"{f.name}: invalid {name}")))
    errs = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    raw_cols = [F.col(c).alias("_raw_" + c) for c in raw.columns]
    return raw.select(*typed, *raw_cols, errs.alias("_errors"))


def _good(checked: DataFrame, schema: T.StructType) -> DataFrame:
    return checked.filter(F.size("_errors") == 0).select([f.name for f in schema.fields])


def validate(raw: DataFrame, schema: T.StructType = TRANSCRIPTS) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, errors) in one projection.

    A row is bad if a REQUIRED field is missing or a value does not convert
    to its declared type. ``good`` has the declared schema; ``errors`` keeps
    the raw values plus ``errors``, the messages joined by ``"; "``.
    """
    checked = _checked(raw, schema)
    bad = checked.filter(F.size("_errors") > 0).select(
        *[F.col("_raw_" + c).alias(c) for c in raw.columns],
        F.array_join("_errors", "; ").alias("errors"))
    return _good(checked, schema), bad


def _is_path(where: str) -> bool:
    return "/" in where


def _plain(spark: SparkSession, path: str) -> bool:
    """A folder with files or folders of rows that no version lists."""
    fs, p = V.hadoop(spark, path)
    return fs.exists(p) and any(f.getPath().getName()[0] not in "_." and not f.getPath().getName().startswith(f"{V.COMMIT}=")
                                for f in fs.listStatus(p))


def append(df: DataFrame, where: str, schema: T.StructType = TRANSCRIPTS, cluster: bool = True) -> None:
    """Add rows to a table (path or catalog name) and keep the old ones (K1).

    A missing REQUIRED value fails the write and nothing is added. ``cluster``
    brings the rows of a date together first (one shuffle), so that an append leaves
    few files for a date; without it every task writes a file for each of its
    dates, which ``compact`` can merge later.
    """
    spark = df.sparkSession
    out, parts = _with_partition(require(conform(df, schema), schema))
    if not _is_path(where):
        if spark.catalog.tableExists(where):
            out.write.insertInto(where)
        else:
            out.write.partitionBy(*parts).option("path", new_table_path(spark, where)).saveAsTable(where)
    elif V.head(spark, where) is None and _plain(spark, where):
        out.write.mode("append").partitionBy(*parts).parquet(where)
    else:
        _add(out, where, schema, bool(parts), cluster)


def _add(out: DataFrame, path: str, schema: T.StructType, dated: bool, cluster: bool = True, drop=()) -> V.Version:
    """Write ``out`` and give the table a version with its rows and without the segments ``drop``."""
    spark = out.sparkSession
    commit = V.stage(out, path, dated, cluster)
    try:
        new = V.measure(spark, path, commit, schema, dated)
        version = V.change(spark, path, new, drop)
    except Exception:
        V.discard(spark, path, commit)
        raise
    if not new:
        V.discard(spark, path, commit)
    spark.catalog.refreshByPath(path)
    return version


#: Writes of one date that a stream leaves before they are merged.
MERGE_AT = 32


def append_batch(df: DataFrame, path: str, schema: T.StructType, stream: str, batch: int,
                 merge_at: int = MERGE_AT, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Add a stream's micro-batch to a versioned table exactly once.

    The table remembers each stream's last batch (one number), so a batch that is
    replayed after a failure is skipped. When a date has more than
    ``merge_at`` writes they become one, so files stay bounded however many batches
    there are; ``merge`` may reduce the merged rows.
    """
    spark = df.sparkSession
    if V.has_batch(V.head(spark, path), stream, batch):
        return
    out, parts = _with_partition(require(conform(df, schema), schema))
    commit = V.stage(out, path, bool(parts))
    new = V.measure(spark, path, commit, schema, bool(parts))
    version = V.change(spark, path, new, stream=(stream, batch))
    if not new:
        V.discard(spark, path, commit)
    if max(Counter(s.date for s in version.segments).values(), default=0) > merge_at:
        compact(spark, path, schema, merge_at, merge)


def checked_append(raw: DataFrame, path: str, schema: T.StructType = TRANSCRIPTS,
                   all_or_nothing: bool = True) -> DataFrame:
    """Validate, then append (K3). Returns the error rows.

    ``all_or_nothing`` (the insert call's behaviour): any bad row and nothing
    is written. Otherwise good rows are written and bad rows only returned.

    One pass over ``raw``: its good rows are staged while bad ones are counted,
    and become part of the table only at a count of zero. Only the error rows of a
    refused upload are computed by another pass.
    """
    spark = raw.sparkSession
    good, bad = validate(raw, schema)
    if not all_or_nothing:
        append(good, path, schema)
        return bad
    seen = Observation()
    # a lost task may be counted again: only zero or not matters
    checked = _checked(raw, schema).observe(seen, F.count_if(F.size("_errors") > 0).alias("bad"))
    out, parts = _with_partition(_good(checked, schema))
    if not _is_path(path) or (V.head(spark, path) is None and _plain(spark, path)):
        if bad.limit(1).count():
            return bad
        append(good, path, schema)
        return spark.createDataFrame([], bad.schema)
    commit = V.stage(out, path, bool(parts))
    new = V.measure(spark, path, commit, schema, bool(parts))
    # an adaptive plan without a good row may drop the counter with the rows
    if seen.get["bad"] if new else bad.limit(1).count():
        V.discard(spark, path, commit)
        return bad
    V.change(spark, path, new)
    return spark.createDataFrame([], bad.schema)


def _quoted(name: str) -> str:
    return name if "`" in name else ".".join(f"`{part}`" for part in name.split("."))


def replace(df: DataFrame, where: str, schema: T.StructType) -> None:
    """Truncate and load with the declared schema (K2); ``where`` is a path
    or a catalog table name.

    One pass: all rows are written beside the old ones, REQUIRED values checked
    on the way; then one version file makes them the table. A job that fails
    leaves the old rows, and a reader gets the old rows or the new ones, never
    neither. ``df`` may read the table it replaces, also through subqueries: the
    old files stay until the version after next.
    """
    out, parts = _with_partition(require(conform(df, schema), schema))
    spark = df.sparkSession
    if not _is_path(where):
        _install(out.write.partitionBy(*parts), spark, where, f"{shared_dir(spark)}/warehouse/{where}")
        return
    plain = _plain(spark, where)
    _add(out, where, schema, bool(parts), drop=None)
    if plain:                                   # rows from before the folder had versions
        fs, p = V.hadoop(spark, where)
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name != V.FOLDER and not name.startswith(f"{V.COMMIT}="):
                fs.delete(f.getPath(), True)


def _table_location(spark: SparkSession, name: str) -> str:
    return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)} AS JSON").first()[0])["location"]


def _install(writer: DataFrameWriter, spark: SparkSession, name: str, base: str) -> None:
    """Write a table's new version to its own folder below ``base``, then move the name to it."""
    mark = uuid.uuid4().hex[:12]
    base = base.rstrip("/")
    new, old, files = f"{name}__new_{mark}", f"{name}__old_{mark}", f"{base}/{mark}"
    try:
        writer.option("path", files).saveAsTable(new)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(new)}")
        V.remove(spark, files)
        raise
    before = _table_location(spark, name) if spark.catalog.tableExists(name) else None
    if before:
        spark.sql(f"ALTER TABLE {_quoted(name)} RENAME TO {_quoted(old)}")
    spark.sql(f"ALTER TABLE {_quoted(new)} RENAME TO {_quoted(name)}")
    if before:
        spark.sql(f"DROP TABLE {_quoted(old)}")
        if V.hadoop(spark, before)[1].getParent().toUri().getPath() == V.hadoop(spark, base)[1].toUri().getPath():
            V.remove(spark, before)              # a version written here


def create_as(df: DataFrame, name: str, path: str | None = None,
              bucket_by: tuple[int, list[str]] | None = None) -> DataFrame:
    """CREATE OR REPLACE TABLE name AS <df> (K4) in the session catalog.

    Each version's files go to a folder of their own below ``path`` (default:
    under the shared folder). The new version is complete before the name moves
    to it, so a job that fails leaves the old table; ``df`` may read that table.
    ``bucket_by=(n, keys)`` stores the rows hashed into ``n`` buckets by
    ``keys`` and sorted within each bucket; tables bucketed alike then join
    on those keys with no shuffle, the layout for joins that run again and
    again (policy bindings against stale or wanted lists).
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/warehouse/{name}"
    writer = df.write
    if bucket_by:
        n, keys = bucket_by
        writer = writer.bucketBy(n, *keys).sortBy(*keys)
    _install(writer, spark, name, path)
    return spark.table(name)


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """Rows that survive ``DELETE ... WHERE pred``: a NULL predicate keeps the row."""
    return df.filter(~F.coalesce(pred, F.lit(False)))


def delete_from(spark: SparkSession, where: str, pred: Column,
                schema: T.StructType = TRANSCRIPTS) -> DataFrame:
    """Apply K5 to a stored table (path or name); return the table as it is now.

    Of a versioned table only segments (dates of a write) with a matching row
    are rewritten; all other files stay as they are, and if nothing matches no file
    changes. A predicate on ``id`` is pushed to the scan, where sorted row groups and Bloom
    filters skip most of the table.
    """
    version = V.head(spark, where) if _is_path(where) else None
    if version is None:
        table = read_table(spark, where, schema)
        if table.filter(pred).limit(1).count():         # else every file stays as it is
            replace(delete_where(table, pred).select([f.name for f in schema.fields]), where, schema)
        return read_table(spark, where, schema)
    hit = V.touched(V.scan(spark, where, version.segments, schema, has_dates(schema)), pred)
    _rewrite(spark, where, version, hit, schema, lambda rows: delete_where(rows, pred))
    return read_table(spark, where, schema)


def _rewrite(spark: SparkSession, path: str, version: V.Version, keys: set, schema: T.StructType, keep) -> None:
    """Replace the segments named in ``keys`` by ``keep(their rows)``."""
    if not keys:
        return
    old = V.scan(spark, path, [s for s in version.segments if s.key in keys], schema, has_dates(schema))
    out, parts = _with_partition(keep(old).select([f.name for f in schema.fields]))
    _add(out, path, schema, bool(parts), drop=keys)


def compact(spark: SparkSession, path: str, schema: T.StructType = TRANSCRIPTS, most: int = 1,
            merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
    """Merge the writes of every date that has more than ``most`` of them; the number of dates merged.

    Only those dates are read and written, in files of the advisory partition
    size. ``merge`` may reduce the merged rows (counts of a window to their sum).
    """
    version = V.head(spark, path)
    by_date: dict = {}
    for s in version.segments if version else []:
        by_date.setdefault(s.date, set()).add(s.key)
    many = [keys for keys in by_date.values() if len(keys) > most]
    _rewrite(spark, path, version, set().union(*many), schema, merge)
    return len(many)


def expire(df: DataFrame, ttl_ms: int | None, as_of=None, ts: str = "created_at") -> DataFrame:
    """Rows younger than ``ttl_ms`` at ``as_of`` (K6); ``None`` keeps all.

    On date-partitioned tables whole expired partitions are pruned.
    """
    if ttl_ms is None:
        return df
    cutoff = as_of_col(as_of) - millis(ttl_ms)
    return prune_dates(df, cutoff).filter(F.col(ts) > cutoff)


def expire_table(spark: SparkSession, path: str, ttl_ms: int | None, as_of=None,
                 schema: T.StructType = TRANSCRIPTS, ts: str = "created_at") -> DataFrame:
    """Remove the rows of a versioned table that are ``ttl_ms`` old or older at ``as_of`` (K6); the table as it is now.

    Segments whose last time is old enough are dropped from the table without
    opening a file, those whose first time is not stay; only the ones in between (the
    date of the cut-off) are read and rewritten.
    """
    version = V.head(spark, path)
    if ttl_ms is None or version is None:
        return read_table(spark, path, schema)
    cutoff = now_value(spark, as_of_col(as_of) - millis(ttl_ms))
    first = lambda s, i: dt.datetime.fromisoformat(s.bounds[ts][i])
    known = [s for s in version.segments if ts in s.bounds]
    gone = {s.key for s in known if first(s, 1) <= cutoff}
    part = {s.key for s in known if first(s, 0) <= cutoff} - gone
    if part:
        old = V.scan(spark, path, [s for s in version.segments if s.key in part], schema, has_dates(schema))
        out, parts = _with_partition(expire(old, ttl_ms, F.lit(cutoff) + millis(ttl_ms), ts).select(schema.fieldNames()))
        _add(out, path, schema, bool(parts), drop=gone | part)
    elif gone:
        V.change(spark, path, [], gone)
    return read_table(spark, path, schema)


def table_profile(spark: SparkSession, path: str, schema: T.StructType = TRANSCRIPTS) -> DataFrame:
    """Row count, bytes, files, created/modified times and field names.

    Of a versioned table all of it is in the version file: no data file is
    opened, and ``created`` is the time of the first version. A plain
    folder takes one scan of file metadata columns.
    """
    version = V.head(spark, path)
    names = ",".join(schema.fieldNames())
    if version:
        total = lambda what: sum(getattr(s, what) for s in version.segments)
        row = (total("rows"), total("bytes"), total("files"), dt.datetime.fromisoformat(version.created),
               dt.datetime.fromisoformat(version.modified), names)
        return spark.createDataFrame([row], "num_rows long, num_bytes long, num_files long, "
                                            "created timestamp_ntz, modified timestamp_ntz, field_names string")
    df = read_table(spark, path, schema)
    per_file = (df.select("_metadata.file_path", "_metadata.file_size",
                          "_metadata.file_modification_time")
                  .groupBy("file_path")
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.first("file_size").alias("size"),
                       F.first("file_modification_time").alias("mtime")))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("num_rows"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("num_bytes"),
        F.count(F.lit(1)).alias("num_files"),
        F.min("mtime").alias("created"),
        F.max("mtime").alias("modified"),
        F.lit(names).alias("field_names"),
    )
