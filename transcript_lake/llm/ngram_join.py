"""Similarity self-join on word n-gram sets, and the groups it forms.

Two documents link when the Jaccard similarity of their shingle sets (runs of
``n`` words) is at least ``percent`` / 100. The method is the token-combination
prefix filter:

* Shingles have one global order: by how often they occur, rare first (counted
  over all documents in a fixed-size table of hash buckets), then by hash.
* Two linked sets share at least ``L`` shingles among their *extended
  prefixes*, the first ``size - ceil(t * size) + L`` shingles of each: at most
  ``overlap - L`` shared ones can lie behind either prefix.
* With ``L = RARE + 1`` it is enough to look for ``RARE`` common shingles of
  the rare class, or one common *pair* of the frequent class: of ``L`` shared
  shingles either ``RARE`` are rare or two are frequent.
* A shingle that is the k-th shared one at positions i and j of two sets in
  the global order leaves at most ``k - 1 + min(size_x - i, size_y - j)``
  shared ones, so positions rule out most pairs before any set is fetched.
* A set's *parity* is 256 bits, each telling whether an odd number of its
  shingles hash there. Parities differ in at most as many bits as the sets do
  in shingles, which rules out most other pairs that are not similar.
* Candidates are verified on the whole sets.

Groups are found without listing all pairs of a group. Equal sets are one
class, and each task indexes a class once. Then every shingle of the index
proposes only links to the document that holds it at the smallest position,
the one with the fewest shingles of its own (linear in the index); verified
links give first groups. After that, only shingles found in two or more
*groups* can still join anything: those in at most ``FREQUENT`` groups
are the rare class and propose pairs from different groups, the others do so
in combinations of two. Pairs of groups are found first, from one row for each
group, and rare shingles count only where two groups share ``RARE`` of them or
a frequent pair; so rows of one group never meet.
The smaller group's rows are taken to the larger one's, where positions and
parities are compared within the join. So no link between different groups is
missed, a large group is not repeated for every group it meets, and rows come
out only of pairs that those filters let through. Comparisons (not rows) of two
groups that share that many shingles, yet have no link so far, are the product of their sizes.

The index holds 64-bit hashes, ids and positions; texts are never shuffled,
only the sets of candidates are (found by a bit table of bounded size, which
lets a few others through). A shingle in a third of all
documents is pre-aggregated in every task and its join side split by AQE.

Words are runs of characters other than white space, A-Z lower-cased. A text
with fewer than ``n`` words has its whole sequence as one shingle; one without
words (or null) has none and links with nothing. Rows that repeat an id count
as one document. A null id has no group (null). Other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from math import log2
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from . import textvec as T
from .components import components
from .ship import ship
from .tables import discard, stored

N, PERCENT = 4, 85
RARE = 3                    # common rare shingles that make a candidate
BITS = 20                   # hash buckets that count shingles
CHUNK = 1 << 16
MOST_BITS = 27              # of the table that finds candidates' texts: 16 MB
FREQUENT = 32               # groups that share a shingle of the rare class at most
PARITY = ["b0", "b1", "b2", "b3"]
_SALT = np.uint64(0xA0761D6478BD642F)


def shingles(s: T.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) of every text of the slice."""
    rows, _, _, h = s.words(T.WORDS)
    r, x = T.windows(rows, h, n)
    size = np.bincount(rows, minlength=len(s))
    short = size[rows] < n                      # whole sequences of fewer words
    if short.any():
        sr, sh = rows[short], h[short]
        at = np.arange(len(sr)) - np.searchsorted(sr, sr)
        mixed = T.mix(sh + (at + 1).astype(np.uint64) * _SALT)
        first = np.flatnonzero(np.r_[True, sr[1:] != sr[:-1]])
        r = np.concatenate([r, sr[first]])
        x = np.concatenate([x, T.mix(np.add.reduceat(mixed, first) ^ _SALT)])
    return T.distinct(r, x)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    cut = np.searchsorted(rows, np.arange(n + 1))
    return (total[cut[1:]] - total[cut[:-1]]).astype(np.int64)


def _stored(df: DataFrame, name: str, made: list[DataFrame] | None = None) -> DataFrame:
    """``stored``, and noted in ``made`` so that the caller can discard it."""
    out = stored(df, name)
    if made is not None:
        made.append(out)
    return out


def _parity(rows: np.ndarray, x: np.ndarray, n: int) -> list[pa.Array]:
    """256 bits per row as four long columns."""
    odd = np.bincount(rows * 256 + (x & np.uint64(255)).astype(np.int64), minlength=n * 256) & 1
    longs = np.packbits(odd.astype(np.uint8).reshape(n, 256), axis=1).view(np.int64)
    return [pa.array(longs[:, j].copy()) for j in range(4)]


def signatures(docs: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """One pass: (id, size, a, b) per text, and the task's bucket counts in chunks.

    ``a`` and ``b`` are sums over the set, so equal sets have equal
    (size, a, b). Count rows have ``chunk`` and ``counts`` instead.
    """
    schema = "id long, size long, a long, b long, chunk int, counts binary"
    ship(docs.sparkSession)

    def run(batches):
        seen = np.zeros(1 << bits, np.uint32)
        null = lambda k, kind: pa.nulls(k, kind)
        for batch in batches:
            for s in T.slices(batch.column(1)):
                rows, x = shingles(s, n)
                seen += np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                k = len(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, k), pa.array(np.bincount(rows, minlength=k)),
                     pa.array(_sums(rows, x, k)), pa.array(_sums(rows, T.mix(x ^ _SALT), k)),
                     null(k, pa.int32()), null(k, pa.binary())],
                    names=["id", "size", "a", "b", "chunk", "counts"])
        if seen.any():
            parts = [zlib.compress(c.tobytes(), 1) for c in np.split(seen, len(seen) // CHUNK)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays(
                [null(k, pa.int64())] * 4 + [pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())],
                names=["id", "size", "a", "b", "chunk", "counts"])

    return docs.mapInArrow(run, schema)


def bucket_classes(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """How frequent each hash bucket is, on a scale of quarter powers of two."""
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.uint64)
        for batch in batches:
            for c in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                total += np.frombuffer(zlib.decompress(c), np.uint32)
        level = np.round(4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()])],
                                         names=["chunk", "level"])

    parts = (rows.where("chunk is not null").select("chunk", "counts").groupBy("chunk")
             .applyInArrow(add, "chunk int, level binary").collect())       # 2^bits bytes in all
    out = np.zeros(1 << bits, np.uint8)
    for chunk, level in parts:
        out[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(level, np.uint8)
    return out


def prefixes(docs: DataFrame, levels: np.ndarray, n: int, percent: int) -> DataFrame:
    """(id, size, prefix, parity): extended prefixes in the global order, once per task for equal sets."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    bits = int(log2(len(levels)))

    def run(batches):
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for s in T.slices(batch.column(1)):
                rows, x = shingles(s, n)
                k = len(s)
                size = np.bincount(rows, minlength=k)
                sums = zip(_sums(rows, x, k).tolist(), _sums(rows, T.mix(x ^ _SALT), k).tolist())
                new = np.array([m > 0 and key not in done and not done.add(key)
                                for m, key in zip(size.tolist(), sums)], bool)
                live = new[rows]
                rows, x = rows[live], x[live]
                parity = _parity(rows, x, k)
                level = shared.value[(x >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((x, level, rows))
                rows, x = rows[order], x[order]
                want = size - (percent * size + 99) // 100 + RARE + 1
                cut = np.searchsorted(rows, np.arange(k + 1))
                keep = np.arange(len(x)) - cut[rows] < want[rows]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, k), pa.array(size),
                     T.lists(rows[keep], x[keep].view(np.int64), k, pa.int64()), *parity],
                    names=["id", "size", "prefix", *PARITY])
                yield out.filter(pa.array(new))

    return docs.mapInArrow(run, "id long, size long, prefix array<long>, " + ", ".join(f"{b} long" for b in PARITY))


def bit_table(ids: DataFrame) -> np.ndarray:
    """Bits at the top hash bits of ``ids``: 16 bits for each id, at most 2^MOST_BITS in all."""
    n = ids.count()
    bits = int(min(max(log2(16 * n + 1) + 1, 16), MOST_BITS))
    chunk = 1 << 16

    def mark(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(chunk, bool)
        for batch in batches:
            table[batch.column(1).to_numpy() % chunk] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(table).tobytes()])],
                                         names=["chunk", "bits"])

    at = ids.select(F.shiftrightunsigned(F.xxhash64("id"), 64 - bits).alias("at")).distinct()
    parts = (at.select(F.shiftright("at", 16).alias("chunk"), "at").groupBy("chunk")
             .applyInArrow(mark, "chunk long, bits binary").collect())      # 2^bits bits in all
    table = np.zeros((1 << bits) // 8, np.uint8)
    for c, packed in parts:
        table[c * chunk // 8:(c + 1) * chunk // 8] = np.frombuffer(packed, np.uint8)
    return table


def shingle_sets(docs: DataFrame, table: np.ndarray, n: int) -> DataFrame:
    """(id, tokens): the whole shingle sets of the rows whose id is in the bit table."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    bits = int(log2(len(table) * 8))
    rows = docs.select("id", "text", F.shiftrightunsigned(F.xxhash64("id"), 64 - bits).alias("at"))

    def run(batches):
        t = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((t[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for s in T.slices(batch.column(1)):
                r, x = shingles(s, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, len(s)), T.lists(r, x.view(np.int64), len(s), pa.int64())],
                    names=["id", "tokens"])

    return rows.mapInArrow(run, "id long, tokens array<long>")


def _needed(percent: int, a: str = "sx", b: str = "sy") -> Column:
    """Shared shingles that sets of two sizes need: percent of their union."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _left(size_a: str = "sx", at_a: str = "px", size_b: str = "sy", at_b: str = "py") -> Column:
    """Shared shingles there can be from a shared one on."""
    return F.least(F.col(size_a) - F.col(at_a), F.col(size_b) - F.col(at_b))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough."""
    left = sets.select(F.col("id").alias("x"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("id").alias("y"), F.col("tokens").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    return (pairs.select("x", "y").join(right, "y").join(left, "x")
            .withColumn("both", both)
            .where(100 * F.col("both") >= percent * (F.size("tx") + F.size("ty") - F.col("both")))
            .select("x", "y"))


def _alike(percent: int) -> Column:
    """The parities leave room for enough shared shingles."""
    apart = sum((F.bit_count(F.col(f"{b}x").bitwiseXOR(F.col(f"{b}y"))) for b in PARITY), F.lit(0))
    return apart <= F.col("sx") + F.col("sy") - 2 * _needed(percent)


def plausible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that sizes and parities do not rule out."""
    side = lambda v: known.select(F.col("id").alias(v), F.col("size").alias(f"s{v}"),
                                  *[F.col(b).alias(f"{b}{v}") for b in PARITY])
    return pairs.join(side("x"), "x").join(side("y"), "y").where(_alike(percent)).select("x", "y").distinct()


def with_hubs(index: DataFrame) -> DataFrame:
    """The rows (token, id, size, at) of shingles with two or more holders, and the first holder (y, sy, py)."""
    hub = (index.groupBy("token").agg(F.count("*").alias("n"), F.min_by("id", "at").alias("y"),
                                      F.min_by("size", "at").alias("sy"), F.min("at").alias("py"))
           .where("n > 1").drop("n"))
    return index.join(hub, "token")


def star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(x, y): documents that share ``RARE`` shingles whose first holder is y."""
    pairs = shared.withColumnsRenamed({"id": "x", "size": "sx", "at": "px"}).where("x <> y")
    return (pairs.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("sx").alias("sx"), F.min("sy").alias("sy"),
                                        F.min("px").alias("px"), F.min("py").alias("py"))
            .where((F.col("n") >= RARE) & (_left() >= _needed(percent))).select("x", "y"))


def _relabel(shared: DataFrame, groups: DataFrame) -> DataFrame:
    named = shared.join(groups, "id", "left")
    return named.withColumn("g", F.coalesce("component", "id")).drop("component")


def _meets(index: DataFrame, key: list[str], percent: int, before: int) -> DataFrame:
    """(key, gx, gy): pairs of groups with a common key whose rows can fit, from one row for each group.

    ``gy`` is the one with fewer rows of that key. Where both have one, its parity is looked at too.
    """
    side = lambda v: {c: f"{c}{v}" for c in ("g", "s", "n", "m", "c", *PARITY)}
    groups = index.groupBy(*key, "g").agg(F.min("size").alias("s"), F.max(F.col("size") - F.col("at")).alias("n"),
                                          F.max(F.col("size") - F.col("later")).alias("m"), F.count("*").alias("c"),
                                          *[F.min(b).alias(b) for b in PARITY])
    a, b = (groups.withColumnsRenamed(side(v)) for v in "xy")
    need = _needed(percent)
    fits = (F.struct("cx", "gx") > F.struct("cy", "gy")) & (F.least("nx", "ny") + before >= need)
    fits = fits & (F.least("mx", "my") + RARE >= need) & ((F.col("cx") > 1) | _alike(percent))
    return a.join(b, key).where(fits).select(*key, "gx", "gy")


def _both_ways(df: DataFrame) -> DataFrame:
    """With (ga, gb), the pair of groups whichever has more rows."""
    return df.withColumn("ga", F.least("gx", "gy")).withColumn("gb", F.greatest("gx", "gy"))


def _across(index: DataFrame, meets: DataFrame, key: list[str], percent: int, before: int) -> DataFrame:
    """(x, y, ga, gb, left, need) of common keys from the pairs of groups ``meets``; rows of one group never meet.

    A pair of groups takes the smaller one's rows to the larger one's, and positions and
    parities are compared there, so a large group is not repeated for every group it meets.
    At most ``before`` shared shingles lie before position ``at``, and ``RARE`` before ``later``.
    """
    side = lambda v: {"g": f"g{v}", "id": v, "size": f"s{v}", "at": f"p{v}", "later": f"q{v}"} | {b: f"{b}{v}" for b in PARITY}
    cols = [*key, "id", "g", "size", "at", "later", *PARITY]
    a, b = (index.select(cols).withColumnsRenamed(side(v)) for v in "xy")
    fits = _left() + before >= _needed(percent)
    fits = fits & (_left(at_a="qx", at_b="qy") + RARE >= _needed(percent)) & _alike(percent)
    same = [F.col(f"b.{c}") == F.col(f"a.{c}") for c in [*key, "gx"]]
    few = meets.join(b, [*key, "gy"]).alias("b")
    rows = few.join(a.alias("a"), reduce(and_, same) & fits).select("x", "y", "a.gx", "gy", "px", "py", "sx", "sy")
    turn = F.col("gx") > F.col("gy")
    return _both_ways(rows).select(F.when(turn, F.col("y")).otherwise(F.col("x")).alias("x"),
                                   F.when(turn, F.col("x")).otherwise(F.col("y")).alias("y"),
                                   "ga", "gb", _left().alias("left"), _needed(percent).alias("need"))


def group_pairs(shared: DataFrame, groups: DataFrame, parities: DataFrame, percent: int,
                frequent: int = FREQUENT, made: list[DataFrame] | None = None) -> DataFrame:
    """Candidate pairs between different groups, by single rare and paired frequent shingles."""
    index = _relabel(shared, groups)
    spread = (index.groupBy("token", "g").agg(F.min("size").alias("s")).groupBy("token")
              .agg(F.count("*").alias("k"), F.min("s").alias("least")).where("k > 1"))
    # the smallest partner a holder can have bounds how far back its position may be
    index = (index.join(spread, "token")
             .withColumn("least", F.greatest("least", F.ceil(F.lit(percent) * F.col("size") / F.lit(100))))
             .where(F.col("size") - F.col("at") + RARE >= _needed(percent, "size", "least")))
    live = _stored(index.join(parities, "id"), "live", made)
    # a document's frequent shingles, at most its prefix; all combinations of two
    often = (live.where(F.col("k") > frequent).groupBy("id", "g", "size", *PARITY)
             .agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("ts")))
    pairs = (often.select("id", "g", "size", *PARITY, "ts", F.posexplode("ts").alias("i", "a"))
             .select("id", "g", "size", *PARITY, "a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("b"))
             .select("id", "g", "size", *PARITY, F.col("a.token").alias("t1"), F.col("b.token").alias("t2"),
                     F.col("a.at").alias("at"), F.col("b.at").alias("later")))
    two = ["t1", "t2"]          # pairs that one group alone holds meet nothing
    often = _stored(_across(pairs, _meets(pairs, two, percent, RARE - 1), two, percent, RARE - 1), "often", made)
    # rare shingles count where two groups share enough of them, or beside a frequent pair
    single = live.where(F.col("k") <= frequent).withColumn("later", F.col("at"))
    meets = _stored(_both_ways(_meets(single, ["token"], percent, RARE)), "meets", made)
    enough = (meets.groupBy("ga", "gb").agg(F.count("*").alias("n")).where(F.col("n") >= RARE).select("ga", "gb")
              .union(often.select("ga", "gb")).distinct())
    rare = _across(single, meets.join(enough, ["ga", "gb"]).drop("ga", "gb"), ["token"], percent, RARE)
    none = F.lit(None).cast("long")
    both = (rare.select("x", "y", F.lit(1).alias("r"), F.col("left").alias("lr"), none.alias("lf"), "need")
            .union(often.select("x", "y", F.lit(0), none, "left", "need")))
    # before the first rare one lies at most one other; before the first frequent one only the rare ones found
    return (both.groupBy("x", "y").agg(F.sum("r").alias("r"), F.max("lr").alias("lr"), F.max("lf").alias("lf"),
                                       F.max("need").alias("need"))
            .where(((F.col("r") >= RARE) & (F.col("lr") + 1 >= F.col("need")))
                   | (F.col("lf") + F.col("r") >= F.col("need"))).select("x", "y"))


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT,
                    id_col: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``, whatever ``frequent`` is."""
    if percent < 80:
        raise ValueError("prefixes with three rare shingles need a similarity of 0.8 or more")
    shared_dir(docs.sparkSession)               # checkpoints need their folder
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    made: list[DataFrame] = []                  # tables that only the steps up to the groups read
    known = _stored(signatures(rows, n), "sets")
    levels = bucket_classes(known)
    known = known.where("chunk is null").select("id", "size", "a", "b")

    index = _stored(prefixes(rows.where("id is not null"), levels, n, percent), "prefix", made)
    whole = index.select("id", "size", *PARITY).dropDuplicates(["id"])
    index = index.select("id", "size", F.posexplode("prefix").alias("at", "token"))
    shared = _stored(with_hubs(index), "shared", made)
    stars: list[DataFrame] = []
    pairs = _stored(plausible(star_pairs(shared, percent), whole, percent), "pairs", stars)
    groups = components(_stored(verified(pairs, rows, n, percent, stars), "links", stars))
    discard(*stars)
    others = _stored(group_pairs(shared.select("id", "size", "at", "token"), groups,
                                 whole.drop("size"), percent, frequent, made), "pairs", made)
    second = verified(others, rows, n, percent, made)
    # now whole groups are vertices
    joins = (second.join(groups.select(F.col("id").alias("x"), F.col("component").alias("gx")), "x", "left")
             .join(groups.select(F.col("id").alias("y"), F.col("component").alias("gy")), "y", "left")
             .select(F.coalesce("gx", "x").alias("x"), F.coalesce("gy", "y").alias("y")))
    merged = components(joins)
    discard(*made)
    top = merged.select(F.col("id").alias("component"), F.col("component").alias("top"))
    named = (groups.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("c"))
             .union(merged.select("id", "component")).groupBy("id").agg(F.min("c").alias("c")))
    classes = (known.where("size > 0 and id is not null").join(named, "id", "left")
               .groupBy("size", "a", "b").agg(F.min("id").alias("m"), F.min("c").alias("c")))
    least = classes.where("c is not null").groupBy("c").agg(F.min("m").alias("least"))
    classes = classes.join(least, "c", "left").select("size", "a", "b", F.coalesce("least", "m").alias("group"))
    out = known.join(classes, ["size", "a", "b"], "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("group", "id")).alias("component_id"))


def verified(pairs: DataFrame, rows: DataFrame, n: int, percent: int, made: list[DataFrame] | None = None) -> DataFrame:
    """The links among candidate pairs, by the whole shingle sets of their texts."""
    ids = pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "id")
    sets = _stored(shingle_sets(rows, bit_table(ids), n), "tokens", made)
    return verify(pairs, sets, percent)
