"""Product-quantised codes of vectors, with nearest entries found by Orchard search.

A vector becomes integers (floor of ``scale`` times each component), is cut into ``parts``
equal consecutive parts, and each part is replaced by the number of its nearest
entry in that part's codebook. Codebooks start from the vectors with the
smallest ids; each round assigns every part of every vector and moves each
entry to the floor of the mean of its parts (an unused entry stays).

Orchard search finds the nearest entry. Every entry keeps a list of all
entries by distance to it. A search holds a current entry and walks its list: an entry
closer to the vector becomes the current one and its list is walked from the start;
entries met before are marked and skipped. The walk ends at the first entry that
is more than twice as far from the current entry as the vector is, since by
the triangle inequality every entry from there on is further from the vector
than the current one. Entries at equal distance are never cut off so,
therefore ties go to the lower number exactly. Distances are squared integers
("twice" is then a factor of four), so all results are exact. The searches of a
batch advance together, one list position at a time, as numpy arrays.

A round is one pass over the vectors. Tasks send one row of sums and counts for
a codebook entry (parts * entries rows, whatever the data); only the codebooks
themselves go through the driver and to the tasks, ``parts * entries`` short lists.

Defined results: rows whose vector is null or holds a null, NaN or infinite
component are dropped. The width is that of the kept vector with the smallest id; kept vectors of
another width, which have no parts to compare, get a null code and error. An id that repeats gives one starting entry
(its smallest vector); all its rows are coded. A row without an id is coded but
starts no entry (with only such rows, starting entries are missing and codes are null).
Fewer ids than entries make smaller codebooks. An empty table gives no rows. Components
beyond ``largest`` (2^18 for 64 components at scale 256) would not fit exact 64-bit
distances and raise an error. Columns are taken by name and renamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .tables import stored

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
SEARCHES = 1 << 15          # that advance together


def largest(dim: int) -> int:
    """Scaled components up to this size have exact 64-bit distances."""
    return isqrt((1 << 62) // (4 * max(dim, 1))) // 2


def finite(vec: Column) -> Column:
    """The vector is there and so are all of its components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, odd), F.lit(False))


def scaled(column: pa.Array, dim: int, scale: int = SCALE) -> np.ndarray:
    """Integer vectors, a row each."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(x * scale).reshape(len(column), dim)
    if len(x) and dim and np.abs(x).max() > largest(dim):
        raise ValueError(f"a component is too large for exact distances: {np.abs(x).max() / scale}")
    return x.astype(np.int64)


class Codebooks:
    """Entries of every part, and each entry's list of all entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries                                          # (part, entry, position)
        self.parts, self.size, self.width = entries.shape
        gap = entries[:, :, None, :] - entries[:, None, :, :]
        apart = (gap * gap).sum(3)
        self.order = np.argsort(apart, axis=2, kind="stable")           # ties: lower number first
        self.apart = np.take_along_axis(apart, self.order, 2)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of every vector, by Orchard search."""
        n = len(vectors)
        code, error = np.empty((n, self.parts), np.int64), np.empty((n, self.parts), np.int64)
        step = max(1, SEARCHES // self.parts)
        for i in range(0, n, step):
            some = vectors[i:i + step]
            x = some.reshape(len(some) * self.parts, self.width)
            c, e = self._search(x, np.tile(np.arange(self.parts), len(some)))
            code[i:i + step], error[i:i + step] = c.reshape(len(some), -1), e.reshape(len(some), -1)
        return code, error

    def _search(self, x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.size
        books = self.entries.reshape(self.parts * k, self.width)
        order, apart = self.order.reshape(-1), self.apart.reshape(-1)
        base = part * k

        def distance(q: np.ndarray, entry: np.ndarray) -> np.ndarray:
            gap = x[q] - books[base[q] + entry]
            return np.einsum("ij,ij->i", gap, gap)

        every = np.arange(len(x))
        current, at = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        best = distance(every, current)
        seen = np.zeros((len(x), k), bool)
        seen[:, 0] = True
        live = every
        while len(live):
            place = (base[live] + current[live]) * k + at[live]
            go = apart[place] <= 4 * best[live]                         # else: beyond twice the distance
            live, place = live[go], place[go]
            entry = order[place]
            at[live] += 1
            new = ~seen[live, entry]
            q, entry = live[new], entry[new]
            seen[q, entry] = True
            d = distance(q, entry)
            closer = (d < best[q]) | ((d == best[q]) & (entry < current[q]))
            q = q[closer]
            current[q], best[q], at[q] = entry[closer], d[closer], 0    # walk the closer entry's list
            live = live[at[live] < k]
        return current, best

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def first_ids(ids: DataFrame, most: int) -> list:
    """The smallest distinct values of the one column ``id``; a pass finds them unless ids repeat."""
    found: list = []
    while len(found) < most:
        rest = ids.where("id is not null" if not found else F.col("id") > F.lit(found[-1]))
        more = {r.id for r in rest.orderBy("id").limit(most - len(found)).collect()}
        if not more:
            break
        found = sorted(more | set(found))
    return found


def start(rows: DataFrame, dim: int, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks of the parts of the vectors with the smallest ids."""
    ids = first_ids(rows.select("id"), entries)
    firsts = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").collect()
    vecs = pa.array([r.vec for r in firsts], pa.list_(pa.float64()))                # ``entries`` at most
    cut = scaled(vecs, dim, scale).reshape(len(firsts), parts, dim // parts)
    return Codebooks(np.ascontiguousarray(cut.transpose(1, 0, 2)))


def refine(rows: DataFrame, books: Codebooks, dim: int, scale: int = SCALE) -> Codebooks:
    """One round: assign every part, then move each entry to the floored mean of its parts."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(books)
    parts, size, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, count = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
        for batch in batches:
            x = scaled(batch.column(0), dim, scale).reshape(len(batch), parts, width)
            at = books.nearest(x)[0] + np.arange(parts) * size
            np.add.at(total, at.reshape(-1), x.reshape(at.size, width))
            count += np.bincount(at.reshape(-1), minlength=parts * size)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
            names=["entry", "n", "total"])

    exact = [F.sum(F.col("total")[j].cast("decimal(38,0)")) for j in range(width)]
    rows = (rows.select("vec").mapInArrow(sums, "entry long, n long, total array<long>")
            .groupBy("entry").agg(F.sum("n").alias("n"), F.array(*exact).alias("total")).collect())
    new = books.entries.copy()
    for entry, n, total in rows:                                        # parts * entries rows at most
        new[entry // size, entry % size] = [int(t) // n for t in total]
    return Codebooks(new)


def coded(rows: DataFrame, books: Codebooks, dim: int, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error) of every row; nulls where the width is another."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, width = books.parts, books.width

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            x = scaled(batch.column(2), dim, scale).reshape(len(batch), parts, width)
            code, error = books.nearest(x)
            text = code.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()),
                 pa.array(error.sum(1))], names=["id", "label", "code", "error"])

    fits = F.size("vec") == dim
    none = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    if not books.size:
        return rows.select("id", "label", *none)
    schema = rows.select("id", "label").schema.add("code", "string").add("error", "long")
    return (rows.where(fits).select("id", "label", "vec").mapInArrow(encode, schema)
            .union(rows.where(~fits).select("id", "label", *none)))


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a whole vector.

    ``error`` is the squared distance to the coded vector, ``label_error`` its
    sum over the rows of the same label (null is a label too).
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits a part: 1 to 256 entries")
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                     F.col(vec_col).cast("array<double>").alias("vec")).where(finite(F.col("vec")))
    dim = rows.where("id is not null").agg(F.min(F.struct("id", F.size("vec").alias("dim"))).alias("m")).first().m
    dim = dim.dim if dim else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    alike = rows.where(F.size("vec") == dim)
    books = start(alike, dim, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = refine(alike, books, dim, scale)
    out = stored(coded(rows, books, dim, scale), "codes")
    by_label = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return (out.join(by_label, F.col("label").eqNullSafe(F.col("of")))
            .select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")))
