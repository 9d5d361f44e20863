"""Toxicity score: FTRL-proximal logistic regression on hashed word n-grams.

Features of a text are the distinct hashes of its words, word pairs and
skip-grams (two words with one between), folded to ``2^BITS`` coordinates.
FTRL-proximal gives every coordinate its own learning rate, and its L1 term
leaves most weights at exactly zero, so the model is a small table of bounded
size (at most ``2^BITS`` numbers) that is broadcast to score all documents.

Training uses a bounded sample of the labelled rows (``max_rows``, expected
size; all of them if there are fewer). FTRL is an online method, so the
sample is one group, taken in the order of a hash of the id: the result does
not depend on the partitioning.

Null or empty text: no features, the score is the bias alone. Rows without an
id are scored but cannot carry a label. Repeated rows are scored alike; for
repeated labels the largest wins. With no label at all every score is 0.5
(the weights are zero) or the prior given by the bias. Other columns are
ignored and never reach a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as T

BITS = 20
MAX_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 0.1
_BIAS = 0


def feature_ids(s: T.Slice, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every feature, not yet distinct within a row."""
    rows, _, _, h = s.words(T.ALNUM)
    keep_r, keep_f = [rows], [h]
    for gap, salt in ((1, 0x51ED27), (2, 0xA24BAED)):
        ok = rows[:-gap] == rows[gap:]
        keep_r.append(rows[:-gap][ok])
        keep_f.append(T.mix(h[:-gap][ok] * np.uint64(2 * salt + 1) + h[gap:][ok]))
    size = (1 << bits) - 1
    ids = (np.concatenate(keep_f) % np.uint64(size)).astype(np.int64) + 1
    return np.concatenate(keep_r), ids


def ftrl(docs: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS,
         alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-proximal over documents given as arrays of distinct coordinates."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i):
        zi = z[i]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0.0)
        shrunk[i == _BIAS] = zi[i == _BIAS]                 # the bias has no L1
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for i, y in zip(docs, labels):
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(1 << bits))


def _distinct_ids(s: T.Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rows, ids = feature_ids(s, bits)
    rows, ids = T.distinct(rows, ids.astype(np.uint64))
    return rows, ids.astype(np.int64)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id",
        max_rows: int = MAX_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights from rows (key, text, label 0/1); a bounded sample of them is used."""
    rows = (labelled.select(F.col(key).alias("k"), F.col(text).alias("text"),
                            F.col(label).cast("int").alias("y"))
            .where("y is not null and k is not null")
            .withColumn("h", F.xxhash64("k")))
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * max_rows / total))
    def coordinates(batch: pa.RecordBatch, s: T.Slice) -> pa.RecordBatch:
        r, ids = _distinct_ids(s, bits)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(s), np.int32)), batch.column(0), batch.column(1),
             T.lists(r, ids.astype(np.int32), len(s), pa.int32())], names=["sample", "h", "y", "ids"])

    # texts become coordinates where they are; only those go to the trainer
    rows = T.map_slices(rows.select("h", "y", "text"), coordinates, "sample int, h long, y int, ids array<int>")

    def train(group: pa.Table) -> pa.Table:
        h, y = group.column("h").to_numpy(), group.column("y").to_numpy()
        ids = group.column("ids").combine_chunks()
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        feats = [np.append(flat[a:b], _BIAS).astype(np.int32) for a, b in zip(off[:-1], off[1:])]
        order = np.lexsort((y, h))
        w = ftrl([feats[i] for i in order], [int(y[i]) for i in order], bits)
        nz = np.flatnonzero(w)
        return pa.table({"i": nz, "w": w[nz]})

    got = rows.groupBy("sample").applyInArrow(train, "i long, w double").toPandas()
    out = np.zeros(1 << bits, np.float32)
    out[got["i"].to_numpy()] = got["w"].to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score``; every text is read whole."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(weights.astype(np.float32))
    bits = int(np.log2(len(weights)))
    cols = docs.select(*keep, F.col(text).alias("__text"))
    schema = cols.select(*keep).schema.add("score", "double")

    def run(batch: pa.RecordBatch, s: T.Slice) -> pa.RecordBatch:
        w = model.value
        rows, ids = feature_ids(s, bits)
        live = w[ids] != 0
        rows, ids = T.distinct(rows[live], ids[live].astype(np.uint64))
        total = np.bincount(rows, weights=w[ids.astype(np.int64)], minlength=len(s))
        p = 1.0 / (1.0 + np.exp(-np.clip(total + w[_BIAS], -35, 35)))
        return pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(len(keep))] + [pa.array(p)],
            names=[*keep, "score"])

    return T.map_slices(cols, run, schema, "__text")


def fold(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def train_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, text, label) of the labelled rows outside the held-out fold."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
             .where(F.col("label").isNotNull() & (fold("doc_id", folds) != held))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    return docs.select("doc_id", "text").where(fold("doc_id", folds) != held).join(known, "doc_id")
