"""Line deduplication across documents, with DataFrame functions only.

Each text is split at newlines. A line's key is the line without white space
at its ends, with A-Z lower-cased. Keys of at least ``min_chars`` characters
found in at least ``min_docs`` different documents lose all their lines except
those in the largest id that holds the key.

Plan: the lines are exploded once with their positions and hashed (two 64-bit
hashes, so that unequal keys do not meet); long ones are kept as (id, text hash, position,
hashes). Distinct (hash, id) pairs, reduced in every task, are counted per
hash, and the frequent hashes are joined back to the positions. What is left
per text is the list of its positions to drop; the text meets it in one
shuffle, is split again and put together from the other positions. All
steps are linear in the lines of a text, however often one repeats. A hash held by a third of all
documents is pre-aggregated in every task, and its join side is split by AQE.

Null or empty text: one empty line, never dropped. A null id: the lines do not
count as a document and none is dropped. Rows that repeat an id count as one
document; each loses its own lines by the same rule. Other columns of ``docs``
pass unchanged: where one is called like a count, the count's name gets
underscores (``count_names``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 20, 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line_key(line)).alias("a"), F.xxhash64(F.lit(1), line_key(line)).alias("b"))


def count_names(columns: list[str]) -> tuple[str, str]:
    """What ``n_lines`` and ``n_dropped`` are called beside these columns."""
    names = []
    for name in ("n_lines", "n_dropped"):
        while name in columns:
            name += "_"
        names.append(name)
    return names[0], names[1]


def long_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, pos, a, b): every line with a long key, by its text's hash and its position there."""
    lines = (docs.where(F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
             .where(F.char_length(line_key(F.col("line"))) >= min_chars)
             .select("id", "th", "pos", _hashes(F.col("line")).alias("k")))
    return lines.select("id", "th", "pos", "k.a", "k.b")


def frequent_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(a, b, keep) of the keys in enough documents, and the largest id that has it."""
    held = lines.select("id", "a", "b").distinct()
    counted = held.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("keep"))
    return counted.where(F.col("n") >= min_docs).select("a", "b", "keep")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the text's surviving lines, and ``n_lines`` and ``n_dropped``."""
    lines = stored(long_lines(docs, id_col, text, min_chars), "lines")
    drops = stored(lines.join(frequent_keys(lines, min_docs), ["a", "b"]).where(F.col("id") < F.col("keep"))
                   .groupBy(F.col("id").alias("__id"), F.col("th").alias("__th"))
                   .agg(F.collect_list("pos").alias("__drop")), "drops")
    discard(lines)
    joined = docs.join(drops, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    left = F.transform(F.array_except(every, "__drop"), lambda i: F.get("__lines", i))      # by hashing: linear
    n_lines, n_dropped = count_names(docs.columns)
    out = (joined.withColumn("__lines", lines_of(F.col(text)))
           .withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(left)))
    return (out.withColumn(text, F.concat_ws("\n", "__kept"))
            .withColumn(n_lines, F.size("__lines").cast("long"))
            .withColumn(n_dropped, (F.size("__lines") - F.size("__kept")).cast("long"))
            .drop("__id", "__th", "__drop", "__lines", "__kept"))
