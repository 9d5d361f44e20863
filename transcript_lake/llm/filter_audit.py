"""What each filter of a chain removes, in every order the filters can have.

``k`` filters span a lattice of ``2^k`` states, a state being the set of
filters applied so far. An edge adds one filter and removes the documents that
fail it and none of the state's filters. Every order is one path from the
empty state to the full one, so

* ``forward[s]``, the orders that reach state ``s``, is the sum of ``forward``
  over the states one filter before it; ``backward[s]``, those that leave it,
  the sum of ``backward`` over the states one filter after it;
* an edge lies on ``forward[from] * backward[to]`` orders. Weighted so, a
  filter's edge removals add up to its removals over all orders (its Shapley
  value times ``k!``), without looking at any order;
* the steps of a single order are the edges of its path.

Spark reads the texts once and keeps (id, part, digest, failed filters) of a
row; duplicates and labels are joined to that. Then only counts by (part,
failed filters) matter, at most ``2^k`` for a part: they are added up in every
task before the shuffle, so a part with a third of all rows is a few rows per
task. Edges and steps are computed within the row of a part.

Defined results: a null text is empty, a null part the empty string. A
document fails ``DUPLICATE`` if a smaller id has the identical text (by
SHA-256) anywhere in the table; rows that repeat the smallest id do not fail, and a
null id is smaller or larger than none. Labels that repeat an id count if any
row says 1; a document without a label is neither good nor toxic. Columns are
taken by name and renamed, so other columns never clash. An empty table gives
no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Runs of anything else are words.
SPACES = r"[\x20\x09-\x0D]+"
#: Stands for "a smaller id has the identical text".
DUPLICATE = "duplicate"
Failure = Callable[[Column, Column], Column] | str

#: Failure conditions over (text, words) by one-letter name, in bit order.
FILTERS: dict[str, Failure] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
    "E": DUPLICATE,
}
MOST_FILTERS = 6            # 720 orders; edges alone (``edges``) go further


def paths(k: int) -> tuple[list[int], list[int]]:
    """(forward, backward): orders that reach and that leave each of the 2^k states."""
    full = (1 << k) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    bits = [1 << i for i in range(k)]
    for s in range(1, full + 1):
        forward[s] = sum(forward[s ^ b] for b in bits if s & b)
    for s in range(full - 1, -1, -1):
        backward[s] = sum(backward[s | b] for b in bits if not s & b)
    return forward, backward


def lattice(k: int) -> list[dict[str, int]]:
    """The k * 2^(k-1) edges: state, bit added, orders that take the edge."""
    forward, backward = paths(k)
    return [{"state": s, "bit": 1 << i, "weight": forward[s] * backward[s | 1 << i]}
            for s in range(1 << k) for i in range(k) if not s >> i & 1]


def _literal(rows: list[dict], kind: str) -> Column:
    """A constant array of structs."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def failures(docs: DataFrame, filters: dict[str, Failure] = FILTERS, part: str = "source",
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, mask): the bits of the filters that each row of ``docs`` fails."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    own = [F.when(fails(F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(0)
           for i, fails in enumerate(filters.values()) if fails != DUPLICATE]
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(own, F.lit(0)).alias("mask"))
    twice = sum(1 << i for i, fails in enumerate(filters.values()) if fails == DUPLICATE)
    if not twice:
        return rows.drop("digest")
    rows = stored(rows, "failures")
    # one row for a digest, so a join on (digest, id) has no hot key however often a text repeats
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "id"], "left").select(
        "id", "part", (F.col("mask") + F.when(again, F.lit(twice)).otherwise(0)).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters."""
    if labels is None:
        failed = failed.withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    else:
        says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
        told = (labels.select(F.col(id_col).alias("id"), "quality", "toxic").where("id is not null")
                .groupBy("id").agg(says("quality").alias("good"), says("toxic").alias("toxic")))
        failed = failed.join(told, "id", "left")
    return failed.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"),
                                              F.count_if(F.col("toxic") == 1).alias("toxic"))


def edges(counts: DataFrame, k: int) -> DataFrame:
    """(part, edges): per part, in the order of ``lattice``, what each edge keeps and removes."""
    of = F.struct("mask", "n", "good", "toxic")
    rows = counts.groupBy("part").agg(F.collect_list(of).alias("cells"))        # at most 2^k for a part

    def total(what: str, when: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + F.when(when(c["mask"]), c[what]).otherwise(0))

    def edge(e: Column) -> Column:
        fails = lambda m: m.bitwiseAND(e["bit"]) != 0
        gone = lambda m: m.bitwiseAND(e["state"]) != 0
        here = lambda m: fails(m) & ~gone(m)
        return F.struct(
            e["bit"].alias("bit"), e["weight"].alias("weight"),
            total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", here).alias("removed"),
            total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
            total("n", lambda m: m == e["bit"]).alias("unique_fails"),
            total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"))

    steps = _literal(lattice(k), "state int, bit int, weight long")
    return rows.select("part", F.transform(steps, edge).alias("edges"))


def steps(by_edge: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order and step of the order, read from the part's edges."""
    k = len(names)
    if k > MOST_FILTERS:
        raise ValueError(f"{k} filters have too many orders to list; use edges()")
    at = {(e["state"], e["bit"]): i for i, e in enumerate(lattice(k))}
    listed = []
    for order in permutations(range(k)):
        state = 0
        for j, f in enumerate(order):
            listed.append({"o": "".join(names[i] for i in order), "j": j + 1, "e": at[state, 1 << f]})
            state |= 1 << f
    step = F.explode(_literal(listed, "o string, j int, e int")).alias("s")
    # a filter's removals over all orders: its edges, each as often as orders take it
    shapley = F.transform(F.array(*[F.lit(1 << i) for i in range(k)]), lambda b: F.aggregate(
        "edges", F.lit(0).cast("long"),
        lambda t, e: t + F.when(e["bit"] == b, e["weight"] * e["removed"]).otherwise(0)))
    rows = by_edge.withColumn("shapley", shapley).select("part", "edges", "shapley", step)
    e = F.col("edges")[F.col("s.e")]
    own = F.col("shapley")[F.round(F.log2(e["bit"])).cast("int")]
    return rows.select("part", F.col("s.o").alias("filter_order"), F.col("s.j").alias("step"),
                       *[e[c].alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")],
                       own.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame | None = None, filters: dict[str, Failure] = FILTERS,
          part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, counts): every order of ``filters``, applied left to right.

    Counts are documents of the part: kept after the step, removed by it,
    redundant (fails its filter, gone before), unique_fails (fails no other
    filter), good_lost and toxic_lost (removed and so labelled) and shapley (the
    filter's removals summed over all orders).
    """
    counts = cells(failures(docs, filters, part, id_col, text_col), labels, id_col)
    return steps(edges(counts, len(filters)), list(filters))
