"""Declared table schemas.

``nullable=False`` marks a REQUIRED field. Parquet files do not keep NOT NULL,
so REQUIRED is enforced by ``sinks.validate`` before every write.
"""

from __future__ import annotations

from pyspark.sql import types as T

TRANSCRIPTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("content", T.StringType(), False),
])

PROCESSED = T.StructType(TRANSCRIPTS.fields + [
    T.StructField("word_count", T.LongType(), True),
    T.StructField("char_count", T.LongType(), True),
    T.StructField("avg_word_length", T.DoubleType(), True),
    T.StructField("sentiment_score", T.DoubleType(), True),
    T.StructField("topic_confidence", T.DoubleType(), True),
    T.StructField("predicted_topic", T.StringType(), True),
    T.StructField("processing_timestamp", T.TimestampNTZType(), True),
])

# Rows as an uploader sends them: every field is text and may be missing.
RAW_TRANSCRIPTS = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("created_at", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
])

# Date column that written transcript tables are partitioned by, so that
# time filters prune whole directories.
PARTITION_COLUMN = "created_date"

# Access-policy document: {"bindings": [{"role": ..., "members": [...]}]}.
POLICY = T.StructType([
    T.StructField("bindings", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("members", T.ArrayType(T.StringType())),
    ]))),
])

# Audit-log entry; the timestamp is text so that microseconds survive.
AUDIT_ENTRY = T.StructType([
    T.StructField("insertId", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("protoPayload", T.StructType([
        T.StructField("methodName", T.StringType()),
        T.StructField("request", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("authenticationInfo", T.StructType([
            T.StructField("principalEmail", T.StringType()),
        ])),
    ])),
])

# Audit entries that could not be read, with the reason.
AUDIT_ERRORS = T.StructType([T.StructField("entry", T.StringType()), T.StructField("errors", T.StringType())])

# Probe results for one identity on one dataset, in the order they are run.
PROBE_COLUMNS = [
    "dataset_exists", "can_list_tables", "can_get_dataset", "can_create_table",
    "can_read_data", "can_write_data", "can_delete_data", "can_update_dataset",
]


#: Column that keeps a document that is not the JSON its schema declares.
CORRUPT = "_corrupt"


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def required_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]
