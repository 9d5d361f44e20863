"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    filter_audit,
    line_dedup,
    ngram_join,
    packing,
    quality_pu,
    quality_rules,
    sharding,
    simhash,
    token_count,
    toxicity,
    url_filters,
    vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _verdict(held) -> list:
    return ["doc_id", held.alias("held_out"), "score",
            (F.col("score") >= 0.3).cast("int").alias("predicted")]


def op1_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = toxicity.fit(toxicity.train_rows(docs, labels, "toxic", 4, 2))
    scored = toxicity.score(docs, weights, "doc_id")
    return scored.select(*_verdict(toxicity.fold("doc_id", 4) == 2))


def op3_decontamination(spark, sf_dir):
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    pairs = decontaminate.contaminated_pairs(docs, benchmark)
    return pairs.withColumn("contaminated", F.lit(True))


def op4_quality(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_pu.fit_labelled(docs, labels)
    scored = quality_pu.score(docs, model, "doc_id")
    return scored.select(*_verdict(toxicity.fold("doc_id", 5) == 0))


def op2_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op6_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), 4, 85)


def op8_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_url_filters(spark, sf_dir):
    judged = url_filters.judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    packed = packing.pack(docs, _tokenizer("byte_bpe_50k.json"), 1024, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_token_count(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return token_count.count_tokens(docs, _tokenizer("piece_bpe_32k.model"), "doc_id")


def op10_sharding(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.shard(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_toxicity, op2_quality_rules, op3_decontamination, op4_quality, op5_url_filters,
    op6_ngram_join, op7_packing, op8_line_dedup, op9_token_count, op10_sharding, op11_filter_audit,
    op12_vector_codes, op13_simhash)}
