"""SimHash fingerprints and the groups that near ones form, by meet-in-the-middle ball hashing.

A fingerprint has a bit for each of 64: set if more than half of the text's
word ``n``-gram hashes (XXH64, seed 42) have it set. Two fingerprints link when
they differ in at most ``radius`` bits (even). Then, and only then, some
*variant* lies within ``radius / 2`` bits of both. So every fingerprint emits all
variants within half the radius, and fingerprints that emit the same variant
are linked: 2,081 variants each for a radius of four, and nothing is compared
with anything else.

The variants are shuffled by their leading bits. A fingerprint is sent once to
each leading part that its variants have (37 of them for 8 bits, with 2,081
variants), and the flips of the other bits are made where it arrives. That is
the same set of variants, each met in exactly one task, in far fewer rows. How many leading
bits there are follows the number of fingerprints, so that a task's variants
stay near ``VARIANTS / 4``. Fingerprints are not spread evenly: where the
variants of one leading part exceed ``VARIANTS`` (counted from the distinct
leading parts, before any row is made), its rows go on to ``DEEPER`` more leading bits, as often
as needed. At 64 bits a part is a single variant, which no more than 2,081 distinct
fingerprints can emit, so every group that reaches a task is bounded without
leaving anything out.

All holders of a variant are within the radius of each other. Each is linked to the smallest of
them only (links linear in the variants); of a part's links, deduplicated, only those of a spanning
forest leave the task (fewer than its fingerprints), and their distance is verified. Groups are the connected components of the links.
Equal fingerprints are one vertex, so any number of copies costs one.

Words are runs of characters other than white space, A-Z lower-cased, repeats
included. A text with fewer than ``n`` words has its whole sequence as one
n-gram; one without words (or null) has fingerprint zero and is linked like any other. A row
without an id gets a fingerprint and no group (null), and links nothing. Rows that repeat an id count
as one document with several fingerprints, linked to each other; each row is returned with
that group. Other columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from . import textvec as T
from .components import components
from .ship import ship
from .tables import discard, stored

N, RADIUS, SEED = 4, 4, 42
VARIANTS = 1 << 21          # that a task holds of one leading part: 16 MB
DEEPER = 6                  # leading bits added to a part with more
FEWEST_BITS = 4
SMALL = 100_000             # leading parts with more variants, up to which they are broadcast
_AT_ONCE = 1 << 16          # n-grams hashed before their bits are counted
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, n: int = N) -> int:
    """The fingerprint of one UTF-8 text as an unsigned number."""
    words = text.translate(_LOWER).split()              # at \x20 and \x09-\x0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) < n:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[:len(words) - n + 1].tolist(), ends[n - 1:].tolist()
    count = np.zeros(64, np.int64)
    for i in range(0, len(first), _AT_ONCE):
        grams = [digest(joined[a:b], SEED) for a, b in zip(first[i:i + _AT_ONCE], last[i:i + _AT_ONCE])]
        bits = np.unpackbits(np.frombuffer(b"".join(grams), np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = N, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of every row; ``fp`` holds the 64 bits as a long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column(1)):
                raw, cut = s.data.tobytes(), s.offsets.tolist()
                fp = np.array([fingerprint(raw[a:b], n) for a, b in zip(cut, cut[1:])], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, len(s)), pa.array(fp.view(np.int64))],
                                                 names=["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def flips(bits: int, most: int) -> list[list[int]]:
    """By number of flips: every mask of that many of ``bits`` bits."""
    return [[sum(1 << i for i in c) for c in combinations(range(bits), j)] for j in range(most + 1)]


def ball(bits: int, most: int) -> int:
    """How many masks of at most ``most`` of ``bits`` bits there are."""
    return sum(comb(bits, j) for j in range(most + 1))


def _flips(bits: int, left: Column, half: int) -> Column:
    """Array of (mask, left): flips of ``bits`` bits that ``left`` allows, and what is left then."""
    by_cost = flips(bits, half)
    out = F.lit(None).cast("array<struct<mask:long,left:int>>")
    for have in range(half, -1, -1):
        rows = [{"mask": m, "left": have - j} for j in range(have + 1) for m in by_cost[j]]
        given = F.from_json(F.lit(json.dumps(rows)), "array<struct<mask:long,left:int>>")
        out = F.when(left == have, given).otherwise(out)
    return out


def _left(half: int, tail: int) -> Column:
    """Flips a row (lead, fp) may still make in its ``tail`` other bits."""
    own = F.shiftrightunsigned("fp", tail) if tail < 64 else F.lit(0).cast("long")
    return F.lit(half) - F.bit_count(F.col("lead").bitwiseXOR(own))


def deepen(rows: DataFrame, tail: int, step: int, half: int) -> DataFrame:
    """Rows (lead, fp) of ``64 - tail`` leading bits sent on to all parts of ``step`` more bits."""
    rest = tail - step
    own = F.shiftrightunsigned("fp", rest) if rest else F.col("fp")
    own = own.bitwiseAND(F.lit((1 << step) - 1)) if step < 64 else own
    f = F.explode(_flips(step, _left(half, tail), half)).alias("f")
    lead = F.shiftleft("lead", step) if tail < 64 else F.lit(0).cast("long")
    return (rows.select(lead.alias("up"), own.alias("own"), "fp", f)
            .select(F.col("up").bitwiseOR(F.col("own").bitwiseXOR(F.col("f.mask"))).alias("lead"), "fp"))


def crowded(rows: DataFrame, tail: int, step: int, half: int, most: int) -> DataFrame:
    """(lead) of parts of ``step`` more bits that more than ``most`` variants fall into.

    Counted over the distinct leading parts of the fingerprints, a row for each.
    """
    rest = tail - step
    prefix = F.shiftrightunsigned("fp", rest) if rest else F.col("fp")
    cells = (rows.groupBy("lead", prefix.alias("p")).agg(F.count("*").alias("n"))
             .select("lead", F.shiftleft("p", rest).alias("fp") if rest else F.col("p").alias("fp"), "n"))
    f = F.explode(_flips(step, _left(half, tail), half)).alias("f")
    lead = F.shiftleft("lead", step) if tail < 64 else F.lit(0).cast("long")
    own = F.shiftrightunsigned("fp", rest) if rest else F.col("fp")
    own = own.bitwiseAND(F.lit((1 << step) - 1)) if step < 64 else own
    weight = F.element_at(F.array(*[F.lit(ball(rest, j)) for j in range(half + 1)]), F.col("f.left") + 1)
    return (cells.select(lead.alias("up"), own.alias("own"), "n", f)
            .select(F.col("up").bitwiseOR(F.col("own").bitwiseXOR(F.col("f.mask"))).alias("lead"),
                    (F.col("n") * weight).alias("w"))
            .groupBy("lead").agg(F.sum("w").alias("w")).where(F.col("w") > most).select("lead"))


def meetings(lead: int, fp: np.ndarray, tail: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one) that emit a common variant of the leading part ``lead``."""
    low = np.uint64((1 << tail) - 1)
    own = fp & low | np.uint64((lead << tail) & (1 << 64) - 1)
    left = half - np.bitwise_count(own ^ fp).astype(np.int64)
    masks = flips(tail, half)
    blocks = []
    for have in range(half + 1):
        rows = np.flatnonzero(left == have)
        if len(rows):
            given = np.array([m for j in range(have + 1) for m in masks[j]], np.uint64)
            blocks.append((rows, own[rows][:, None] ^ given))
    variants = np.concatenate([b.reshape(-1) for _, b in blocks])
    variants.sort()
    twice = np.unique(variants[1:][variants[1:] == variants[:-1]])
    none = fp[:0].view(np.int64)
    if not len(twice):
        return none, none
    maybe = np.zeros(1 << 16, bool)                     # most variants are met once: a quick look first
    maybe[((twice * _MIX) >> np.uint64(48)).astype(np.int64)] = True
    of, holders = [], []
    for rows, block in blocks:
        r, c = np.nonzero(maybe[((block * _MIX) >> np.uint64(48)).astype(np.int64)])
        v = block[r, c]
        at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = twice[at] == v
        of.append(at[hit])
        holders.append(rows[r[hit]])
    of, holders = np.concatenate(of), fp[np.concatenate(holders)].view(np.int64)
    order = np.lexsort((holders, of))
    of, holders = of[order], holders[order]
    first = holders[np.searchsorted(of, of)]            # the smallest holder of each variant
    pairs = np.unique(np.stack([first, holders], 1)[holders != first], axis=0)
    return forest(pairs)


def forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (y, x), taken in order, that join two trees so far, as (x, y): one less than there are vertices at most."""
    names, at = np.unique(pairs, return_inverse=True)
    top, keep = list(range(len(names))), []
    for i, (a, b) in enumerate(at.reshape(-1, 2).tolist()):
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        if a != b:
            top[max(a, b)] = min(a, b)
            keep.append(i)
    return pairs[keep, 1], pairs[keep, 0]


def _meet(tail: int, half: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        x, y = meetings(key[0].as_py(), fp, tail, half) if len(fp) > 1 else (fp[:0], fp[:0])
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return meet


def links(fps: DataFrame, radius: int = RADIUS, most: int = VARIANTS) -> DataFrame:
    """(x, y): verified links among the distinct fingerprints ``fp``, enough to connect all that are near.

    ``most`` bounds the variants a task holds; the links connect the same whatever it is.
    """
    if radius % 2 or radius < 0:
        raise ValueError("a variant in the middle needs an even radius")
    half = radius // 2
    ship(fps.sparkSession)
    n, step = fps.count(), FEWEST_BITS
    while step < 32 and n * ball(64 - step, half) >> step > most // 4:
        step += 1
    rows, tail, found, between = fps.select(F.lit(0).cast("long").alias("lead"), "fp"), 64, [], []
    while tail:
        step = min(step, tail)
        rest = tail - step
        hot = stored(crowded(rows, tail, step, half, most), "crowded") if rest else None
        n_hot = hot.count() if rest else 0
        sent = deepen(rows, tail, step, half)
        few = F.broadcast(hot) if 0 < n_hot <= SMALL else hot           # else Spark joins by shuffling
        here = sent.join(few, "lead", "left_anti") if n_hot else sent
        met = here.groupBy("lead").applyInArrow(_meet(rest, half), "x long, y long")
        found.append(met.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius))
        if not n_hot:
            break
        between.append(hot)
        rows = stored(sent.join(few, "lead", "left_semi"), "deeper")
        between.append(rows)
        tail, step = rest, DEEPER
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = stored(out.distinct(), "links")
    discard(*between)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, n: int = N, id_col: str = "doc_id",
                    text: str = "text", most: int = VARIANTS) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``."""
    shared_dir(docs.sparkSession)               # checkpoints need their folder
    rows = stored(fingerprints(docs, n, id_col, text), "fingerprints")
    kept = rows.where("id is not null")
    classes = stored(kept.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    # an id on several rows links their fingerprints
    same = (kept.groupBy("id").agg(F.min("fp").alias("y"), F.max("fp").alias("top")).where("y <> top")
            .select("id", "y").join(kept, "id").select(F.col("fp").alias("x"), "y").where("x <> y"))
    near = links(classes.select("fp"), radius, most)
    of = components(near.union(same)).withColumnsRenamed({"id": "fp", "component": "c"})
    discard(near)
    linked = classes.join(of, "fp")
    least = linked.groupBy("c").agg(F.min("least").alias("component_id"))
    named = (classes.join(of, "fp", "left").join(least, "c", "left")
             .select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
