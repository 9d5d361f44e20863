"""Corpus preparation: documents in, packed token sequences out.

``STAGES`` are applied in order; each takes ``(spark, docs, sf_dir)``, works on
all that the stage before kept, and is written as Parquet and read again
before the next. All but the last return the columns of ``documents``.

1. quality: documents that the positive-unlabelled classifier rejects go.
2. lines: lines repeated across documents go; the text and ``n_chars`` follow.
3. near duplicates: of each group (five-word shingles, similarity of 0.8 or
   more) the document with the smallest id stays.
4. decontamination: documents that hold a benchmark passage go.
5. packing: what is left is tokenised and packed; one row per piece.

Documents without an id pass stages 1 to 4 on their own merits (they are no
duplicate of anything). An empty table passes as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm import decontaminate, line_dedup, ngram_join, packing, quality_pu
from transcript_lake.llm.tables import discard, stored

QUALITY_THRESHOLD = 0.3
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_pu.accept(docs, quality_pu.fit_labelled(docs, labels), QUALITY_THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        n_dropped = line_dedup.count_names(docs.columns)[1]
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.char_length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    extra = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, tokenizer, packing.WINDOW, keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packed)]

#: The classifier and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
            if k:
                discard(before)             # no later stage reads it
    return docs
