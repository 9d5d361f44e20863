"""Word and shingle hashes of whole Arrow batches, computed with numpy.

All words of a batch are hashed together: a byte table maps each byte to its
word form (0 for a separator), prefix sums of ``T[byte] * P^i`` give the
polynomial hash of any byte range, and multiplying by the inverse power makes
it independent of the position. Hashes are 64 bit; equal words always agree,
and two different words collide with probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .ship import ship

SLICE_BYTES = 1 << 19       # rows are handled in slices of about this much text
_BLOCK = 1 << 18            # bytes hashed at once, cut at a separator
_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_C = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_T = mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(_P))


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte (A-Z lower-cased if asked) plus one."""
    t = np.arange(1, 257, dtype=np.uint16)
    if lower:
        t[ord("A"):ord("Z") + 1] += 32
    t[list(separators)] = 0
    return t


WHITE = bytes([0x20, *range(0x09, 0x0E)])
WORDS = byte_table(WHITE)                                     # [^\x20\x09-\x0D]+
ALNUM = byte_table(bytes(i for i in range(128) if not chr(i).isalnum()))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK + 4096)
        inv = pow(_P, -1, 1 << 64)
        out = []
        for base in (_P, inv):
            p = np.full(size, base & _M64, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def _hash_block(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    pw, inv = _power_tables(len(codes) + 1)
    cs = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_T[codes] * pw[:len(codes)], out=cs[1:])
    return mix((cs[ends] - cs[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


class Slice:
    """Rows ``lo:hi`` of a string column as one byte buffer with row offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        self.data = data[offsets[lo]:offsets[hi]]
        self.offsets = (offsets[lo:hi + 1] - offsets[lo]).astype(np.int64)

    def __len__(self) -> int:
        return self.hi - self.lo

    def words(self, table: np.ndarray, hashed: bool = True):
        """(row of each word, start, end, 64-bit hash) in text order."""
        codes = table[self.data]
        n = len(codes)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0, np.uint64)
        is_word = codes != 0
        begin, last = is_word.copy(), is_word.copy()
        begin[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]            # a row end also ends a word
        begin[cut] = is_word[cut]
        last[cut - 1] = is_word[cut - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        rows = np.searchsorted(self.offsets, starts, side="right") - 1
        if not hashed:
            return rows, starts, ends, np.zeros(0, np.uint64)
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):                      # blocks of whole words
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
            a = starts[i]
            out[i:j] = _hash_block(codes[a:ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
            i = j
        return rows, starts, ends, out

    def count(self, table: np.ndarray) -> np.ndarray:
        """Per row: the sum of ``table[byte]`` over its bytes."""
        cs = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(table[self.data], out=cs[1:], dtype=np.int64)
        return cs[self.offsets[1:]] - cs[self.offsets[:-1]]


def windows(rows: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words that lies within one row."""
    m = len(h) - k + 1
    if m <= 0:
        return rows[:0], h[:0]
    acc = h[:m].copy()
    for j in range(1, k):
        acc = acc * _C + h[j:j + m]
    ok = rows[:m] == rows[k - 1:]
    return rows[:m][ok], mix(acc[ok])


def distinct(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, by row and then hash."""
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        rows, h = rows[keep], h[keep]
    return rows, h


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Row slices of a string column (null: empty) of about ``most`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_string()).fill_null("")
    n = len(a)
    if not n:
        return
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + n + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield Slice(data, offsets, lo, hi)
        lo = hi


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch, Slice], pa.RecordBatch | None],
               schema, text: str = "text") -> DataFrame:
    """``mapInArrow`` that calls ``fn(rows, slice)`` on slices of the string column ``text``."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(batch.schema.get_field_index(text))):
                out = fn(batch.slice(s.lo, len(s)), s)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """``values`` (ordered by row) as one Arrow list for each of ``n`` rows."""
    off = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
