"""Clock and calendar helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Text form of DATETIME values used by uploads: seconds, no zone.
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def as_of_col(as_of=None) -> Column:
    """The run's clock as a TIMESTAMP_NTZ column.

    ``None`` reads the clock once per query, as UTC wall time whatever the
    session zone. A Column (a literal or a scalar subquery) is used as is; text or a
    ``datetime`` is parsed as a zone-less DATETIME.
    """
    if as_of is None:
        return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def now_value(spark: SparkSession, clock: Column) -> dt.datetime:
    """The value of a clock expression (one row), where the driver must compare it with file metadata."""
    return spark.range(1).select(clock.cast("timestamp_ntz").alias("t")).first().t


def days(n: int | float) -> Column:
    """An exact day-time interval of ``n`` days (24-hour days, no zone)."""
    return F.lit(dt.timedelta(days=n))


def millis(n: int) -> Column:
    return F.lit(dt.timedelta(milliseconds=n))


def ts_text(c: Column) -> Column:
    return F.date_format(c, TS_TEXT_FORMAT)


#: Fixed value: the form of a log time, RFC 3339 with the zone optional (none: UTC).
LOG_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?$"


def utc_time(text: Column) -> Column:
    """Log time text as a zone-less UTC DATETIME, whatever the session zone; NULL if it is not one.

    ``Z`` and offsets are converted, digits beyond microseconds are cut.
    """
    known = F.when(text.rlike(LOG_TIME), text)
    zoned = known.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = epoch + F.lit(dt.timedelta(microseconds=1)) * F.unix_micros(F.when(zoned, known).try_cast("timestamp"))
    return F.when(zoned, instant).otherwise(known.try_cast("timestamp_ntz"))
