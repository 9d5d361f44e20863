"""Quality rules: a table of thresholds compiled into one Spark projection.

``RULES`` lists (measure, lower bound, upper bound). Every measure is a Spark
expression over the text; ``compile_rules`` turns the table into one boolean
column, so all rules are judged in a single pass of the scan, without a
shuffle and without any user function.

Words are runs of characters other than white space (x20, x09-x0D), lines are
split at newlines. Repeated five-word windows are found inside the row: the
words' 64-bit hashes are combined per window, and only rows whose window array
is longer than its distinct form go on to sort the (hash, position) pairs and
mark the words that repeated windows cover.

A null or empty text has no word, no line and all counts 0, and fails the base
rule. Rows are judged one by one, so ties, repeated rows and null ids need no
rule of their own. Other columns pass unchanged; measures are added under the
names of ``MEASURES`` (a column of such a name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WINDOW = 5
#: Common short words of the four languages of the corpus.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "was", "on", "be", "by"],
    "de": ["der", "die", "und", "den", "von", "das", "mit", "sich", "des", "ist", "im", "ein", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
}
#: (measure, at least, at most); None: no bound.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("mean_word_chars", 1.5, 18),
    ("symbol_ratio", None, 0.2),
    ("upper_ratio", None, 0.6),
    ("bar_ratio", None, 0.2),
    ("words_per_stop_word", None, 30),
    ("dup_line_ratio", None, 0.5),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(WHITE))) > 0


def _windows(words: Column) -> Column:
    """Hash of every run of ``WINDOW`` words, in order; empty for shorter texts."""
    last = F.size(words) - (WINDOW - 1)
    return F.when(last > 0, F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.xxhash64(*[F.element_at(F.col("__h"), i + j) for j in range(WINDOW)]),
    )).otherwise(F.array().cast("array<bigint>"))


def _sorted_windows(win: Column) -> Column:
    return F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated_at(pairs: Column) -> Column:
    """Sorted positions of the windows whose hash a neighbour in ``pairs`` shares."""
    last = F.size(pairs) - 1
    equal = lambda a, b: pairs[F.greatest(a, F.lit(0))]["h"] == pairs[F.least(b, last)]["h"]
    rows = F.filter(F.sequence(F.lit(0), last),
                    lambda i: ((i > 0) & equal(i - 1, i)) | ((i < last) & equal(i, i + 1)))
    return F.sort_array(F.transform(rows, lambda i: pairs[i]["i"]))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every measure that a rule may name."""
    t = F.coalesce(F.col(text), F.lit(""))
    flat = F.btrim(F.regexp_replace(t, "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    out = (docs.withColumn("__t", t).withColumn("__flat", flat)
           .withColumn("__w", F.when(F.length("__flat") > 0, F.split("__flat", " "))
                       .otherwise(F.array().cast("array<string>")))
           .withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
           .withColumn("__win", _windows(F.col("__h")))
           .withColumn("__lines", F.transform(F.filter(F.split("__t", "\n", -1), _has_word),
                                              lambda x: F.xxhash64(x)))
           .withColumn("n_words", F.size("__w").cast("long"))
           .withColumn("word_chars", (F.length("__flat") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long"))
           .withColumn("n_symbols", (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long"))
           .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
           .withColumn("__some", F.size("__win") > F.size(F.array_distinct("__win"))))
    out = (out.withColumn("__p", F.when(F.col("__some"), _sorted_windows(F.col("__win"))))
           .withColumn("__at", F.when(F.col("__some"), _repeated_at(F.col("__p")))))
    # each repeated window adds its words beyond the previous repeated window's end
    gaps = F.transform(F.sequence(F.lit(1), F.size("__at") - 1), lambda i:
                       F.least(F.lit(WINDOW), F.col("__at")[i] - F.col("__at")[i - 1]))
    covered = F.lit(WINDOW) + F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.when(F.col("__some"), covered).otherwise(0).cast("long"))
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.length("__t"), F.lit(1))
    n_lines = F.greatest(F.size("__lines"), F.lit(1))
    letters = F.length(F.translate("__flat", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (out.withColumn("mean_word_chars", F.col("word_chars") / words)
            .withColumn("symbol_ratio", F.col("n_symbols") / words)
            .withColumn("upper_ratio", (F.length("__flat") - letters) / chars)
            .withColumn("bar_ratio", (F.length("__t") - F.length(F.translate("__t", "|", ""))) / words)
            .withColumn("words_per_stop_word", words / (1 + F.size(F.filter(
                "__w", lambda w: F.lower(w).isin(*stop)))))
            .withColumn("dup_line_ratio", F.col("n_dup_lines") / n_lines)
            .drop("__t", "__flat", "__w", "__h", "__win", "__lines", "__some", "__p", "__at"))


def compile_rules(rules=RULES) -> Column:
    """One boolean column: all bounds of the table hold."""
    ok = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            ok = ok & (F.col(name) >= low)
        if high is not None:
            ok = ok & (F.col(name) <= high)
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with all measures, ``base_failed`` and ``kept``."""
    return (measure(docs, text).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & compile_rules(rules)))
