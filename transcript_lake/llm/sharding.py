"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are ordered by a key (text hash, id). Shard boundaries are found without
sorting: each round proposes ``PROBES`` candidate keys per open boundary,
counts the exact bytes below every candidate over all partitions in one
aggregation, and narrows each boundary to the candidate interval that holds
its target, until the bytes below a candidate are within ``tolerance`` of the
target or no key lies between (a single row or identical rows straddle it).
Only then are the rows exchanged, once, by (shard, part of the shard). Parts are
equal slices of the hash range, as many as the bytes ask for, found by arithmetic
on the hash; a slice that a hot text overfills is dealt on by a hash of the ids.
Only the boundaries between shards go through the driver. Slots are numbered
inside the parts and offset by the parts' row counts, so no task has to hold a shard.

Equal texts have equal hashes and stay together unless a group of them crosses
a boundary, which then falls between two ids: one hot text cannot unbalance
the shards. Sizes are UTF-8 bytes of the text plus 1 (null text: 1). A null id
sorts before all others; identical rows share a shard and get different slots.
An empty table has no rows in any shard. Other columns pass unchanged; one called
like a result (``size``, ``shard``, ``slot``) gets an underscore. Ids are integers.
"""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .tables import apart

PROBES = 16
TOLERANCE = 0.0005          # of a shard's bytes
PART_BYTES = 64 << 20        # of text, for one task after the exchange
MOST_SPLIT = 8192           # slices of the hash range that may be dealt on by id
_LOW, _TOP = -(1 << 63), (1 << 63) - 1


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return (docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
            .withColumn("__i", F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)))
            .withColumn("__size", size_of(F.col(text))))


def _below(key: tuple[int, int]) -> Column:
    h, i = F.lit(key[0]).cast("long"), F.lit(key[1]).cast("long")
    return (F.col("__h") < h) | ((F.col("__h") == h) & (F.col("__i") < i))


def _bucket(keys: list[tuple[int, int]]) -> Column:
    """Number of ``keys`` (sorted) at or below the row's key: a binary search in CASE form."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_below(keys[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))
    return search(0, len(keys))


def _between(lo: tuple[int, int], hi: tuple[int, int], ids: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to ``n`` keys strictly between two keys, evenly spread, first over the hash."""
    if hi[0] - lo[0] > 1:
        step = (hi[0] - lo[0]) / (n + 1)
        return sorted({(h, _LOW) for j in range(1, n + 1)
                       if lo[0] < (h := lo[0] + int(step * j)) < hi[0]} or {(lo[0] + 1, _LOW)})
    if hi[0] > lo[0]:       # the hash is settled but for lo[0] itself: split its ids
        top = max(lo[1], ids[1]) + 1
        if top == lo[1] or lo[1] > ids[1]:
            return [(hi[0], _LOW)] if (hi[0], _LOW) != hi else []
        hi = (lo[0], top)
        return [hi, *_between(lo, hi, ids, n)] if lo < hi else [hi]
    a, b = max(lo[1], ids[0] - 1), min(hi[1], ids[1] + 1)
    step = (b - a) / (n + 1)
    return sorted({(lo[0], i) for j in range(1, n + 1)
                   if lo < (lo[0], i := a + int(step * j)) < hi and a < i < b}
                  or ({(lo[0], a + 1)} if a + 1 < b else set()))


def splitters(keys: DataFrame, shares: list[float], tolerance: float = TOLERANCE,
              probes: int = PROBES) -> list[tuple[int, int]]:
    """Boundary keys below which lie ``shares`` of all bytes of ``keys`` (__h, __i, __size)."""
    total, rows, i0, i1 = keys.agg(F.sum("__size"), F.count("*"), F.min("__i"), F.max("__i")).first()
    if not total:
        return [(_TOP, _TOP)] * len(shares)
    allow = tolerance * total * min(b - a for a, b in zip([0, *shares], [*shares, 1]))
    targets = [s * total for s in shares]
    known = {(_LOW, _LOW): 0, (_TOP, _TOP): total}        # exact bytes below a key
    count = {(_LOW, _LOW): 0, (_TOP, _TOP): rows}         # and rows
    found: dict[int, tuple[int, int]] = {}
    while len(found) < len(targets):
        ask: set[tuple[int, int]] = set()
        for k, t in enumerate(targets):
            if k in found:
                continue
            lo = max((x for x in known if known[x] <= t))
            hi = min((x for x in known if known[x] > t), default=(_TOP, _TOP))
            best = min((lo, hi), key=lambda x: abs(known[x] - t))
            more = [x for x in _between(lo, hi, (i0, i1), probes) if x not in known]
            if abs(known[best] - t) <= allow or count[hi] - count[lo] <= 1 or not more:
                found[k] = best
            ask.update(more if k not in found else ())
        if ask:
            cuts = sorted(ask)
            got = {b: (s, n) for b, s, n in keys.groupBy(_bucket(cuts).alias("b")).agg(
                F.sum("__size"), F.count("*")).collect()}         # at most one row per cut
            size = n = 0
            for b, cut in enumerate(cuts):
                size, n = size + got.get(b, (0, 0))[0], n + got.get(b, (0, 0))[1]
                known[cut], count[cut] = size, n
    return [found[k] for k in range(len(targets))]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text",
          tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``: shards of near-equal bytes, numbered part by part.

    The keys (id, hash, size; no text) are written once to the shared folder,
    so that the rounds of counting read only them.
    """
    docs = apart(docs, "size", "shard", "slot")
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/shard-keys-{uuid.uuid4().hex}"
    _keyed(docs, id_col, text).select("__h", "__i", "__size").write.parquet(path)
    keys = spark.read.parquet(path)
    cuts = splitters(keys, [k / shards for k in range(1, shards)], tolerance)
    return number(docs, cuts, id_col, text, keys, part_bytes)


def _slice(bits: int) -> Column:
    """The row's place by the leading ``bits`` of its hash, in the hash's signed order."""
    if not bits:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(_LOW)), 64 - bits)


def number(docs: DataFrame, cuts: list[tuple[int, int]], id_col: str, text: str, keys: DataFrame,
           part_bytes: int = PART_BYTES) -> DataFrame:
    """Exchange once by (shard, part) and number the rows of each shard without gaps.

    A part is a slice of the hash range; a slice that a hot text overfills is dealt on by a hash of the ids.
    """
    total = keys.agg(F.sum("__size")).first()[0] or 0
    bits = max(0, ceil(total / part_bytes) - 1).bit_length()
    limit = max(4 * part_bytes, total // MOST_SPLIT)
    place = {"shard": _bucket(cuts), "__slice": _slice(bits)}
    split = (keys.groupBy(*[c.alias(n) for n, c in place.items()]).agg(F.sum("__size").alias("__b"))
             .where(F.col("__b") > limit)                 # fewer than MOST_SPLIT rows, whatever the input
             .select("shard", "__slice", F.ceil(F.col("__b") / part_bytes).cast("long").alias("__split")))
    part = F.coalesce(F.pmod(F.xxhash64("__i"), F.col("__split")), F.lit(0).cast("long"))
    placed = lambda rows: (rows.withColumns(place).join(F.broadcast(split), ["shard", "__slice"], "left")
                           .withColumn("__part", part).drop("__split"))
    counts = placed(keys).groupBy("shard", "__slice", "__part").agg(F.count("*").alias("__n"))
    first = counts.withColumn("__first", F.sum("__n").over(
        Window.partitionBy("shard").orderBy("__slice", "__part").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("shard", "__slice", "__part").orderBy("__h", "__i", "__size")
    rows = placed(_keyed(docs, id_col, text)).withColumn("__at", F.row_number().over(order) - 1)
    out = rows.join(first.drop("__n"), ["shard", "__slice", "__part"])
    slot = (F.col("__at") + F.coalesce(F.col("__first"), F.lit(0))).cast("long")
    return out.select(*[F.col(_quoted(c)) for c in docs.columns], F.col("__size").alias("size"),
                      F.col("shard").cast("int").alias("shard"), slot.alias("slot"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
