"""The feature pipeline as one plan.

Window read -> fallback rows -> features -> replace the processed table ->
topic summary. Rows never leave the cluster: the only driver work is
starting the write and the summary. A stored source is read once: whether its
window is empty is known from its version file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.features import features, topic_summary
from ..operators.read import recent
from ..sources.schemas import PROCESSED
from ..sources.sinks import replace
from ..sources.tables import or_sample, read_table, recent_or_sample


def run_pipeline(spark: SparkSession, source: str | DataFrame, dest: str, n_days: int = 30,
                 as_of=None, scorer=None) -> DataFrame:
    if isinstance(source, DataFrame):
        rows = or_sample(recent(source, n_days, as_of), as_of)
    else:
        rows = recent_or_sample(spark, source, n_days, as_of)
    processed = features(rows, as_of, scorer).select(PROCESSED.fieldNames())
    replace(processed, dest, PROCESSED)
    return topic_summary(read_table(spark, dest, PROCESSED))
