"""Benchmark decontamination by greedy string tiling.

A document is held against a benchmark item by *tiles*: matching runs of at
least ``MIN_MATCH`` words that do not overlap, taken from the longest down. The
share of the item's words that tiles cover is its coverage; order does not
matter, so a passage whose sentences were moved around is still caught. Words
are runs of letters and digits, A-Z lower-cased.

Each document is scanned once: hashes of its ``MIN_MATCH``-word windows are
looked up among those of the benchmark (the seeds). Only pairs whose seeds could
cover ``threshold`` of the item are tiled, by the running Karp-Rabin search:
windows of a search length are matched by rolling hash, only a match's first pair is
kept, its length is found by a binary search over the hashes, and the longest
free match is marked first; then the length is halved, down to ``MIN_MATCH``. All of
that is numpy over whole arrays, so repeated words cost no loop over their pairs.
Items with equal words are tiled once; where only the verdict on a document is
wanted, its first contaminating item ends the search.

The benchmark is a query set: it is taken in blocks of at most ``BLOCK_BYTES``
of text (or one item), each block is broadcast and all documents are scanned
against it. Nothing is shuffled, so a passage that a third of all documents
share is no hot key.

Items of fewer than ``MIN_MATCH`` words (or null) match nothing, nor do null
or empty texts. Rows are judged one by one: repeated rows give repeated pairs,
repeated items a pair each. Empty tables give no pair. Other columns pass.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as T

MIN_MATCH = 4
THRESHOLD = 0.5
FIRST_LENGTH = 32
BLOCK_BYTES = 16 << 20


class Block:
    """Word hashes of some items, and their seed windows sorted by hash."""

    def __init__(self, ids: list, texts: list, k: int):
        self.k, self.ids, self.words = k, ids, []
        seeds, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in T.slices(pa.array(texts, pa.string())):
            rows, _, _, h = s.words(T.ALNUM)
            cut = np.searchsorted(rows, np.arange(len(s) + 1))
            self.words += [h[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.same: dict[bytes, list[int]] = {}          # items of equal words are tiled once, as the first of them
        for i, w in enumerate(self.words):
            self.same.setdefault(w.tobytes(), []).append(i)
        for i, w in ((ids[0], self.words[ids[0]]) for ids in self.same.values()):
            _, x = T.windows(np.zeros(len(w), np.int64), w, k)
            seeds.append(x)
            item.append(np.full(len(x), i))
            at.append(np.arange(len(x)))
        seeds, item, at = map(np.concatenate, (seeds, item, at))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.at = seeds[order], item[order], at[order]
        self.bits = 20
        self.hit = np.zeros(1 << self.bits, bool)       # a quick first test
        self.hit[(self.seeds >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def pairs(self, s: T.Slice, threshold: float, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(row, item, covered words, tiles) of every pair that reaches the threshold, or of each row's ``first``."""
        rows, _, _, h = s.words(T.ALNUM)
        k = self.k
        m = len(h) - k + 1
        if m <= 0 or not len(self.seeds):
            return []
        _, x = T.windows(np.zeros(len(h), np.int64), h, k)      # across rows; those are skipped next
        at = np.flatnonzero(self.hit[(x >> np.uint64(64 - self.bits)).astype(np.int64)]
                            & (rows[:m] == rows[k - 1:]))
        lo, hi = (np.searchsorted(self.seeds, x[at], side) for side in ("left", "right"))
        found = hi > lo
        at, lo, hi = at[found], lo[found], hi[found]
        if not len(at):
            return []
        n = hi - lo
        dpos = np.repeat(at, n)
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        drow, item, ipos = rows[dpos], self.item[which], self.at[which]
        order = np.lexsort((dpos, item, drow))
        drow, item, ipos, dpos = drow[order], item[order], ipos[order], dpos[order]
        starts = np.flatnonzero(np.r_[True, (drow[1:] != drow[:-1]) | (item[1:] != item[:-1])])
        out: list[tuple[int, int, int, int]] = []
        for a, b in zip(starts, np.r_[starts[1:], len(drow)]):
            if first and out and out[-1][0] == drow[a]:
                continue
            words = self.words[item[a]]
            can = np.zeros(len(words), bool)
            can[(np.unique(ipos[a:b])[:, None] + np.arange(k)).ravel()] = True
            if can.sum() < threshold * len(words):
                continue
            covered, tiles = tile(near(h, dpos[a:b], k), words, k)
            if covered >= threshold * len(words):
                alike = [int(item[a])] if first else self.same[words.tobytes()]
                out += [(int(drow[a]), i, covered, tiles) for i in alike]
        return out


def near(h: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The stretches of ``h`` that windows of ``k`` words starting at ``at`` cover."""
    at = np.unique(at)
    cut = np.flatnonzero(np.diff(at) > k) + 1       # a gap of a word or more ends a stretch
    return [h[p[0]:p[-1] + k] for p in np.split(at, cut)]


def tile(stretches: list[np.ndarray], item: np.ndarray, k: int) -> tuple[int, int]:
    """(covered words of ``item``, tiles) by running Karp-Rabin greedy string tiling.

    The longest match that is still free is marked first, of equal ones the first in the
    document and then in the item. A match that loses words to a longer tile
    goes on with its free runs, so the order is exact also among repeated words.
    """
    gap = np.zeros(1, np.uint64)
    doc = np.concatenate([x for s in stretches for x in (s, gap)])      # stretches do not touch
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    free_d[np.cumsum([len(s) + 1 for s in stretches]) - 1] = False
    sums = _prefixes(doc), _prefixes(item)
    covered = tiles = 0
    length = max(k, min(FIRST_LENGTH, len(item)))
    while True:
        size, d, i = scan(doc, item, free_d, free_i, length, sums)
        heap = list(zip((-size).tolist(), d.tolist(), i.tolist()))
        heapify(heap)
        while heap:
            minus, d0, i0 = heappop(heap)
            free = free_d[d0:d0 - minus] & free_i[i0:i0 - minus]
            if free.all():
                free_d[d0:d0 - minus] = free_i[i0:i0 - minus] = False
                covered, tiles = covered - minus, tiles + 1
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, free, False]))
            for at, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if end - at >= length:                  # shorter runs are found by a later scan
                    heappush(heap, (at - end, d0 + at, i0 + at))
        if length == k:
            return covered, tiles
        length = max(k, length // 2)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the first 0, 1, 2 ... words."""
    out, h = np.zeros(len(words) + 1, np.uint64), 0
    base = int(_BASE)
    for j, w in enumerate(words.tolist(), 1):
        h = (h * base + w) & 0xFFFFFFFFFFFFFFFF
        out[j] = h
    return out


def _free_runs(free: np.ndarray) -> np.ndarray:
    """How many free words there are from each position on without a gap."""
    at = np.arange(len(free))
    blocked = np.where(free, len(free), at)
    return np.minimum.accumulate(blocked[::-1])[::-1] - at


def scan(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, length: int,
         sums: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, start in the document, start in the item) of the maximal free matches of ``length`` words or more."""
    none = (np.zeros(0, np.int64),) * 3
    run_d, run_i = _free_runs(free_d), _free_runs(free_i)
    at_d, at_i = np.flatnonzero(run_d >= length), np.flatnonzero(run_i >= length)
    if not len(at_d) or not len(at_i):
        return none
    window = lambda s, at: s[at + length] - s[at] * _power(length)
    hd, hi = window(sums[0], at_d), window(sums[1], at_i)
    order = np.argsort(hi, kind="stable")
    hi, at_i = hi[order], at_i[order]
    lo, up = np.searchsorted(hi, hd, "left"), np.searchsorted(hi, hd, "right")
    # a start is a match's first pair unless the words before it are free and equal
    open_d, open_i = (at_d > 0) & free_d[at_d - 1], (at_i > 0) & free_i[at_i - 1]
    before_d, before_i = doc[at_d - 1], item[at_i - 1]
    ds, js = [], []
    for a, b in _pieces(up - lo):
        n = (up - lo)[a:b]
        d = np.repeat(np.arange(a, b), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
        first = ~(open_d[d] & open_i[j] & (before_d[d] == before_i[j]))
        ds.append(at_d[d[first]])
        js.append(at_i[j[first]])
    d, i = np.concatenate(ds), np.concatenate(js)
    size = _common(sums, d, i, np.minimum(run_d[d], run_i[i]))
    sure = size >= length
    return size[sure], d[sure], i[sure]


def _pieces(n: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of ``n`` that sum to about ``most``."""
    cut = np.searchsorted(np.cumsum(n), np.arange(most, int(n.sum()) + most, most), "left") + 1
    ends = np.unique(np.minimum(np.r_[cut, len(n)], len(n))).tolist()
    return list(zip([0, *ends[:-1]], ends))


def _power(n: np.ndarray | int) -> np.ndarray:
    """``_BASE`` to the power of each ``n``, modulo 2^64."""
    n = np.asarray(n, np.int64)
    out, square = np.ones(n.shape, np.uint64), _BASE
    with np.errstate(over="ignore"):
        while (n > 0).any():
            out = np.where(n & 1, out * square, out)
            square, n = square * square, n >> 1
    return out


def _common(sums: tuple[np.ndarray, np.ndarray], d: np.ndarray, i: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from ``d`` and from ``i`` on are equal, ``most`` at most: a binary search over prefix hashes."""
    low, high = np.zeros(len(d), np.int64), most.astype(np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        scale = _power(mid)
        same = sums[0][d + mid] - sums[0][d] * scale == sums[1][i + mid] - sums[1][i] * scale
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def blocks(benchmark: DataFrame, item_col: str, text: str, k: int, block_bytes: int):
    """The items in blocks of bounded size, each on the driver only while it is used."""
    items = benchmark.select(F.col(item_col).alias("i"), F.coalesce(text, F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect() if n > 1 else items.collect()
        part.sort(key=lambda r: (r["i"] is None, r["i"], r["t"]))
        yield Block([r["i"] for r in part], [r["t"] for r in part], k)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                       min_match: int = MIN_MATCH, id_col: str = "doc_id", item_col: str = "item_id",
                       text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, item_words, covered_words, tiles, coverage) of pairs at or above the threshold."""
    cols = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    kind = lambda df, c: df.select(c).schema[0].dataType.simpleString()
    schema = (f"`{id_col}` {kind(docs, id_col)}, `{item_col}` {kind(benchmark, item_col)}, "
              "item_words long, covered_words long, tiles long, coverage double")
    item_type = benchmark.select(item_col).schema
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(item_type[0].dataType)
    out = None
    for block in blocks(benchmark, item_col, text, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch, s, shared=shared):
            b = shared.value
            got = b.pairs(s, threshold)
            row, item, covered, tiles = (np.array([g[j] for g in got], np.int64) for j in range(4))
            size = np.array([len(b.words[i]) for i in item], np.int64)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array([b.ids[i] for i in item], arrow),
                 pa.array(size), pa.array(covered), pa.array(tiles), pa.array(covered / np.maximum(size, 1))],
                names=[id_col, item_col, "item_words", "covered_words", "tiles", "coverage"])

        part = T.map_slices(cols, run, schema, "__text")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                      min_match: int = MIN_MATCH, item_col: str = "item_id", text: str = "text",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; one pass, no shuffle."""
    for block in blocks(benchmark, item_col, text, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch, s, shared=shared):
            keep = np.ones(len(s), bool)
            keep[[p[0] for p in shared.value.pairs(s, threshold, first=True)]] = False
            return batch.filter(pa.array(keep))

        docs = T.map_slices(docs, run, docs.schema, text)
    return docs
