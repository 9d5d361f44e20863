"""Packing token sequences into windows by best-fit decreasing.

Texts are tokenised and closed with an end id. Documents longer than the
window are first cut into full windows; what remains (and every shorter
document) is a piece of 1 to ``window`` tokens. Best-fit decreasing takes the
pieces from long to short and puts each into the open window with the least
remaining room that still holds it; a segment tree indexed by remaining room
finds that window.

Equal lengths make equal decisions, so the plan needs only the histogram of
lengths: at most ``window`` numbers, whatever the size of the corpus. The plan
is a list of runs "pieces of this length with ranks from a on go, q to a
window, into windows from b on"; its size is bounded by the window, not by the
data. Spark counts the histogram, ranks the pieces within their length (in
buckets, so that no length lands in one task) and joins them with the plan.

Null or empty text: one piece that holds only the end id. Repeated rows are
separate documents. A null id is kept as null. An empty table gives no piece.
Other columns are not carried.
"""

from __future__ import annotations

import json
import uuid
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from . import textvec as T

WINDOW = 1024
BUCKET_ROWS = 10_000
_encoders: dict[str, object] = {}
_tokenizers: dict[str, object] = {}


# -- tokens --------------------------------------------------------------------

def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _as_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to id, if ids are merge ranks (then tiktoken gives the same ids)."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel"
             and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and not spec.get("normalizer"))
    if not plain:
        return None
    alphabet, vocab = _byte_alphabet(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    return ranks if len(ranks) == 256 + len(merges) else None


#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _whole(path: str):
    """The file's own tokenizer; built when it is needed, for it is large."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return lambda text: _tokenizers[path].encode(text, add_special_tokens=False).ids


def encoder(path: str):
    """text -> ids for a tokenizers file; an added token's string in a text gives the id of that token.

    Where the file's ids are merge ranks, the same vocabulary runs in tiktoken,
    which gives the same ids several times faster (tests compare the two).
    Texts that hold the string of an added token go to the file's own tokenizer.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks, added = _as_ranks(spec), [t["content"] for t in spec.get("added_tokens") or []]
        if ranks is None:
            _encoders[path] = _whole(path)
        else:
            import tiktoken

            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

            def encode(text):
                if any(a in text for a in added):
                    return _whole(path)(text)
                try:
                    return fast.encode_ordinary(text)
                except Exception:       # its pattern engine gives up on some very long runs
                    return _whole(path)(text)

            _encoders[path] = encode
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens): the pieces of every whole text.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.
    """
    cols = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long"

    def run(batch, s):
        encode = encoder(tokenizer)
        row, start, length, ids, total = [], [], [], [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            got = np.array([*encode(t or ""), end_id], "<u4")
            for a in range(0, len(got), window):
                part = got[a:a + window]
                row.append(i)
                start.append(a)
                length.append(len(part))
                ids.append(part.tobytes())
                total.append(len(got))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
            names=[id_col, "start", "length", "ids", "doc_tokens"])

    return T.map_slices(cols, run, schema, "__text")


# -- plan ----------------------------------------------------------------------

class RoomTree:
    """Open windows counted by remaining room; finds the least room of at least ``s``."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, s: int) -> int | None:
        i = s + self.leaves
        if self.count[i]:
            return s
        while i > 1:                            # up to the first subtree on the right that is not empty
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:          # and down to its leftmost leaf
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces per window, first window, offset)."""
    tree, open_, plan, windows = RoomTree(window), {}, [], 0

    def put(room, first, n):
        if n and room:
            open_.setdefault(room, deque()).append((first, n))
            tree.add(room, n)

    for s in sorted(counts, reverse=True):
        rank, left = 0, counts[s]
        while left:
            room = tree.tightest(s)
            if room is None:                    # open as many windows as the rest needs
                n = -(-left // (window // s))
                put(window, windows, n)
                windows += n
                continue
            first, n = open_[room].popleft()
            tree.add(room, -n)
            q = room // s                       # a window just used stays the tightest
            full = min(n, left // q)
            if full:
                plan.append((s, rank, full * q, q, first, window - room))
                put(room - q * s, first, full)
                rank, left, first, n = rank + full * q, left - full * q, first + full, n - full
            if left and n and left < q:
                plan.append((s, rank, left, left, first, window - room))
                put(room - left * s, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return plan


def place(pieces: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` (id, start, length, ...) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}   # at most ``window`` rows
    plan = spark.createDataFrame(
        best_fit_plan(counts, window) or [(0, 0, 0, 1, 0, 0)],
        "__l long, __rank long, __n long, __q long, __first long, __off long")
    buckets = max(1, sum(counts.values()) // bucket_rows)
    rows = pieces.withColumn("__b", F.pmod(F.xxhash64(id_col, "start"), F.lit(buckets)))
    base = (rows.groupBy("length", "__b").agg(F.count("*").alias("__c"))      # lengths x buckets rows
            .withColumn("__base", F.coalesce(F.sum("__c").over(
                Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .select(F.col("length").alias("__bl"), F.col("__b").alias("__bb"), "__base"))
    order = Window.partitionBy("length", "__b").orderBy(id_col, "start")
    ranked = (rows.withColumn("__at", F.row_number().over(order) - 1)
              .join(base, (F.col("length") == F.col("__bl")) & (F.col("__b") == F.col("__bb")))
              .withColumn("__at", F.col("__at") + F.col("__base")))
    hit = ((F.col("length") == F.col("__l")) & (F.col("__at") >= F.col("__rank"))
           & (F.col("__at") < F.col("__rank") + F.col("__n")))
    k = F.col("__at") - F.col("__rank")
    return (ranked.join(F.broadcast(plan), hit)         # the plan's size depends on the window only
            .withColumn("sequence_id", F.col("__first") + F.floor(k / F.col("__q")).cast("long"))
            .withColumn("offset", F.col("__off") + (k % F.col("__q")) * F.col("length"))
            .drop("__b", "__at", "__bl", "__bb", "__base", "__l", "__rank", "__n", "__q", "__first", "__off"))


def stored(spark, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that it is computed once."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0,
         id_col: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Tokenise and pack: one row per piece, with its place.

    ``keep_ids=False`` keeps the crc32 of the ids in their stead, so that no
    ids are written or shuffled.
    """
    pieces = token_pieces(docs, tokenizer, window, end_id, id_col, text)
    if not keep_ids:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(stored(docs.sparkSession, pieces, "pieces"), window, id_col)
