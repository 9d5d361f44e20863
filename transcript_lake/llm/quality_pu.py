"""Quality classifier by positive-unlabelled learning.

Only *positives* are trusted: labelled good texts. The other side of the risk
is unlabelled text, a mixture of good and bad. The class prior (share of good
text in the mixture) is estimated from scores alone, and a linear
model is fitted by minimising the non-negative unbiased risk

    pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])

with the logistic loss, so ``sigmoid(f)`` estimates P(good | text).

A text becomes ``len(FEATURES)`` measures of its characters, words and lines
(no word identities, so no language is favoured); each measure is coded by its
quantile bin among all unlabelled texts. The model is a few hundred numbers.

Fitting uses at most about ``max_rows`` of the labelled positives (a documented
bound). The unlabelled side is every text: measures are taken in one pass over the texts
and stored (a few dozen bytes each), and from them come the quantiles, the score distribution that
the prior follows from, and the unlabelled expectations of the risk and its
gradient in every step, each summed in the tasks. A sample of ``max_rows`` unlabelled rows
only finds the point to start from and the curvature that scales the steps; the
steps go on until the risk over all rows no longer falls. Scoring reads every text whole. Null and empty texts
have all measures zero and get a score like any other. Rows without an id are
scored and never trained on. Repeated rows score alike; of repeated labels the
smallest wins (a text once called bad is no trusted positive). Without any
positive the score is 0.5 everywhere. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import textvec as T
from .tables import discard, stored
from .toxicity import fold

MAX_ROWS = 20_000
BINS = 12
QUANTILES = [.01, .03, .06, .1, .2, .4, .6, .8, .9, .94, .97, .99]
L2, MOST_STEPS, ENOUGH, SCALING_ROWS = 5e-4, 25, 1e-5, 4000
HALVINGS, BALANCED, NEAR = 8, 1e-3, 0.05
FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "marks",
            "exclaim", "bars", "non_ascii", "repeat_next", "repeat_pairs", "distinct",
            "lines_per_word", "repeat_lines"]


def _flags(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int8)
    t[[ord(c) for c in chars]] = 1
    return t


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _flags("0123456789")
_SYMBOL = _flags("#*$%&<>@^~=+{}[]\\_")
_MARK = _flags(".,;:?'\"()-")
_EXCLAIM = _flags("!")
_BAR = _flags("|")
_HIGH = np.repeat(np.array([0, 1], np.int8), 128)
_LINES = T.byte_table(b"\n", lower=False)


def measures(s: T.Slice) -> np.ndarray:
    """One row of ``FEATURES`` for each text of the slice."""
    n = len(s)
    rows, starts, ends, h = s.words(T.ALNUM)
    size = np.diff(s.offsets).astype(float)
    words = np.bincount(rows, minlength=n).astype(float)
    some, w1 = np.maximum(size, 1), np.maximum(words, 1)
    same = (rows[1:] == rows[:-1]) & (h[1:] == h[:-1])
    r2, h2 = T.windows(rows, h, 2)
    pairs = np.bincount(r2, minlength=n).astype(float)
    d1 = np.bincount(T.distinct(rows, h)[0], minlength=n)
    d2 = np.bincount(T.distinct(r2, h2)[0], minlength=n)
    lr, _, _, lh = s.words(_LINES)
    lines = np.bincount(lr, minlength=n).astype(float)
    dl = np.bincount(T.distinct(lr, lh)[0], minlength=n)
    share = lambda table: s.count(table) / some
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.bincount(rows, ends - starts, n) / w1,
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_MARK), share(_EXCLAIM),
        share(_BAR), share(_HIGH), np.bincount(rows[1:][same], minlength=n) / w1,
        1 - d2 / np.maximum(pairs, 1), np.log1p(d1) / np.log1p(w1), lines / w1,
        1 - dl / np.maximum(lines, 1)])


class Model:
    """Bin edges for each measure and one weight for each bin."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") + j * (BINS + 1)
                                for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.weights[self.codes(x)].sum(axis=1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(f, -35, 35)))


def _softplus(x):
    return np.logaddexp(0.0, x)


def cuts_of(good: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Score thresholds: quantiles of the positives."""
    return np.quantile(good, np.linspace(0, 1 - least, 100))


def prior_from(good: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: int, least: float = 0.05) -> float:
    """Share of positives in a mixture of ``n`` with ``above`` scores at or over each of the ``cuts``.

    A high score is positive for sure, so the mixture has about ``pi`` times
    the positives' share above a threshold; the smallest such ratio (with an
    allowance for sampling error) over all thresholds bounds ``pi``. The allowance
    (a tenth at most) is taken off: a prior too high leaves no bad texts to learn
    from, one a little low does no harm.
    """
    p = 1 - np.searchsorted(np.sort(good), cuts, side="left") / len(good)
    u = above / n
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(good)) + 1 / np.sqrt(n))
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    ratio = u[best] / p[best]
    return float(np.clip(max(ratio - slack, 0.9 * ratio), least, 1 - 0.01))


def class_prior(good: np.ndarray, mixed: np.ndarray, least: float = 0.05) -> float:
    """``prior_from`` where the mixture's scores are at hand."""
    cuts = cuts_of(good, least)
    above = len(mixed) - np.searchsorted(np.sort(mixed), cuts, side="left")
    return prior_from(good, cuts, above, len(mixed), least)


def expected(model: Model, w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Of measures: the gradient and the value of the loss of calling them bad, summed."""
    def fn(x: np.ndarray) -> np.ndarray:
        codes = model.codes(x)
        f = w[codes].sum(axis=1) + w[-1]
        g = 1 / (1 + np.exp(-np.clip(f, -35, 35)))
        grad = np.bincount(codes.ravel(), np.repeat(g, codes.shape[1]), len(w))
        grad[-1] = g.sum()
        return np.append(grad, _softplus(f).sum())

    return fn


def curvature(codes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Second derivatives of the mean loss over rows with these codes (some of very many)."""
    codes = codes[::max(1, len(codes) // SCALING_ROWS)]
    one = np.zeros((len(codes), len(w)), np.float32)
    one[np.arange(len(codes))[:, None], codes] = 1
    one[:, -1] = 1
    s = 1 / (1 + np.exp(-np.clip(w[codes].sum(axis=1) + w[-1], -35, 35)))
    return (one * (s * (1 - s)).astype(np.float32)[:, None]).T @ one / max(len(codes), 1)


def risk(w: np.ndarray, good: np.ndarray, prior: float, loss: float) -> tuple[float, float]:
    """(penalised non-negative risk, its part that must not be negative); ``loss`` is the unlabelled mean."""
    f = w[good].sum(axis=1) + w[-1]
    rest = loss - prior * _softplus(f).mean()
    return prior * _softplus(-f).mean() + max(0.0, rest) + L2 / 2 * (w[:-1] ** 2).sum(), rest


Unlabelled = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _mixed_step(w: np.ndarray, good: np.ndarray, prior: float, share: float, unlabelled: Unlabelled,
                sample: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, unlabelled loss) at the least of ``(1 - share) * A + share * U``, by scaled gradient steps from ``w``.

    A step that does not lower the value is halved; the steps end when the value stays.
    """
    def look(w: np.ndarray) -> tuple[float, float, np.ndarray]:
        loss, grad = unlabelled(w)
        f = w[good].sum(axis=1) + w[-1]
        miss = 1 / (1 + np.exp(np.clip(f, -35, 35)))                # of calling a positive good
        pull = lambda g: np.append(np.bincount(good.ravel(), np.repeat(g, good.shape[1]), len(w))[:-1], g.sum()) / len(good)
        value = prior * ((1 - share) * _softplus(-f).mean() - share * f.mean()) + share * loss + L2 / 2 * (w[:-1] ** 2).sum()
        slope = share * grad - prior * pull((1 - share) * miss + share)
        slope[:-1] += L2 * w[:-1]
        return value, loss, slope

    now, loss, slope = look(w)
    step = 1.0
    for _ in range(MOST_STEPS):
        bend = (1 - share) * prior * curvature(good, w) + share * curvature(sample, w) + (L2 + 1e-6) * np.eye(len(w))
        new = w - step * np.linalg.solve(bend, slope)
        then, new_loss, new_slope = look(new)
        if then >= now:
            step /= 2
            if step < 1e-2:
                break
            continue
        small = now - then < ENOUGH * abs(now)
        w, now, loss, slope, step = new, then, new_loss, new_slope, min(1.0, 2 * step)
        if small:
            break
    return w, loss


def descend(w: np.ndarray, good: np.ndarray, prior: float, unlabelled: Unlabelled, sample: np.ndarray,
            low: float = 0.0, high: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, share) at the least non-negative risk, from ``w`` on.

    ``good`` are bin codes of positives; ``unlabelled(w)`` gives the mean loss and gradient
    over all unlabelled rows; codes of a ``sample`` of them scale the steps. The risk is
    the larger of two convex functions, A = pi E_p[l(f)] and U = A + the part that must not be
    negative. Its least point is that of U if the part is not negative there, else that of
    the mixture of both at which the part is zero, found by halving the range of U's ``share``.
    """
    best, share = (np.inf, w, high), high
    for _ in range(HALVINGS):
        w, loss = _mixed_step(w, good, prior, share, unlabelled, sample)
        value, rest = risk(w, good, prior, loss)
        best = min(best, (value, w, share), key=lambda b: b[0])
        if abs(rest) < BALANCED or rest > 0 and share == high:
            break
        low, high = (low, share) if rest < 0 else (share, high)
        share = (low + high) / 2
    return best[1], best[2]


def _flat(prior: float) -> np.ndarray:
    """No measure counts; every score is the prior."""
    return np.append(np.zeros(len(FEATURES) * (BINS + 1)), np.log(prior / (1 - prior)))


def _in_memory(model: Model, mixed: np.ndarray) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    def unlabelled(w: np.ndarray) -> tuple[float, np.ndarray]:
        total = expected(model, w)(mixed) / len(mixed)
        return total[-1], total[:-1]

    return unlabelled


def _ranker(model: Model, good: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Weights that rank texts, fitted without knowing the prior."""
    return descend(_flat(0.5), model.codes(good), 0.5, _in_memory(model, mixed), model.codes(mixed))[0]


def fit_arrays(good: np.ndarray, mixed: np.ndarray, prior: float | None = None) -> Model:
    """Fit on measures of positives and of unlabelled texts that are all at hand."""
    if not len(good) or not len(mixed):
        return Model([np.zeros(0)] * len(FEATURES), _flat(0.5)[:-1], 0.0, 0.5)
    edges = [np.unique(np.quantile(mixed[:, j], QUANTILES))[:BINS] for j in range(mixed.shape[1])]
    model = Model(edges, _flat(0.5)[:-1], 0.0, 0.5)
    if prior is None:       # a first fit on half of the rows ranks the other half, where the prior follows
        prior = 0.5
        if min(len(good), len(mixed)) > 1:
            w = _ranker(model, good[::2], mixed[::2])
            prior = class_prior(w[model.codes(good[1::2])].sum(1), w[model.codes(mixed[1::2])].sum(1))
    w, _ = descend(_flat(prior), model.codes(good), prior, _in_memory(model, mixed), model.codes(mixed))
    return Model(edges, w[:-1], float(w[-1]), prior)


def _measured(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    cols = docs.select(*keep, F.col(text).alias("__text"))
    schema = cols.select(*keep).schema.add("x", ArrayType(DoubleType()))

    def run(batch, s):
        x = pa.array(list(measures(s)), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [x],
                                          names=[*keep, "x"])

    return T.map_slices(cols, run, schema, "__text")


def _edges(rows: DataFrame) -> list[np.ndarray]:
    """Bin edges of each measure: quantiles over all rows, finer towards both ends."""
    at = F.array(*map(F.lit, QUANTILES))
    found = rows.agg(*[F.percentile_approx(F.col("x")[j], at, 10_000).alias(f"q{j}") for j in range(len(FEATURES))]).first()
    return [np.unique(np.array(q or [], float))[:BINS] for q in found]


def _sums(rows: DataFrame, fn, size: int) -> np.ndarray:
    """``fn(measures)``, an array of ``size`` numbers, summed over all rows: added up in every task, then by place."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            x = batch.column(0)
            if len(x):
                total += fn(x.flatten().to_numpy().reshape(len(x), len(FEATURES)))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    added = (rows.select("x").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v"))
             .groupBy("i").agg(F.sum("v").alias("v")).collect())                # ``size`` rows
    out = np.zeros(size)
    for i, v in added:
        out[i] = v
    return out


def fit(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text",
        max_rows: int = MAX_ROWS, prior: float | None = None) -> Model:
    """Fit on ``docs`` (all of them unlabelled) and the ids ``positives`` (trusted good).

    Samples are picked by a hash of the id, so they are the same on every
    run, and each holds about ``max_rows`` rows or all there are.
    """
    def sample(rows: DataFrame, n: int) -> DataFrame:
        if n <= max_rows:
            return rows
        return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))

    def pull(rows: DataFrame) -> np.ndarray:
        got = rows.orderBy(key, "x").select("x").toPandas()
        return np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))

    ids = positives.select(key).where(F.col(key).isNotNull()).distinct()
    rows = stored(_measured(docs.where(F.col(key).isNotNull()), key, text=text), "measures")
    n = rows.count()
    good, some = pull(sample(rows.join(ids, key, "left_semi"), ids.count())), pull(sample(rows, n))
    if not len(good) or not len(some):
        discard(rows)
        return fit_arrays(good, some)
    model = Model(_edges(rows), _flat(0.5)[:-1], 0.0, 0.5)
    if prior is None:
        prior = 0.5
        if min(len(good), len(some)) > 1:       # half of the samples rank, the scores of all rows give the prior
            w = _ranker(model, good[::2], some[::2])
            held = w[model.codes(good[1::2])].sum(1)
            cuts = cuts_of(held)

            def above(x: np.ndarray) -> np.ndarray:
                f = np.sort(w[model.codes(x)].sum(1))
                return np.append(len(f) - np.searchsorted(f, cuts, side="left"), len(f))

            counted = _sums(rows, above, len(cuts) + 1)
            prior = prior_from(held, cuts, counted[:-1], int(counted[-1]))

    def unlabelled(w: np.ndarray) -> tuple[float, np.ndarray]:
        total = _sums(rows, expected(model, w), len(w) + 1) / n
        return total[-1], total[:-1]

    codes, sampled = model.codes(good), model.codes(some)
    w, share = descend(_flat(prior), codes, prior, _in_memory(model, some), sampled)
    w, _ = descend(w, codes, prior, unlabelled, sampled, max(0.0, share - NEAR), min(1.0, share + NEAR))
    discard(rows)
    return Model(model.edges, w[:-1], float(w[-1]), prior)


def score(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score``; every text is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(*keep, F.col(text).alias("__text"))
    schema = cols.select(*keep).schema.add("score", "double")

    def run(batch, s):
        p = shared.value.score(measures(s))
        return pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(len(keep))] + [pa.array(p)], names=[*keep, "score"])

    return T.map_slices(cols, run, schema, "__text")


def fit_labelled(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Model:
    """Fit with the positives of ``labels.quality`` outside the held-out fold.

    Rows of the held-out fold are not even used as unlabelled text.
    """
    train = fold("doc_id", folds) != held
    positives = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & train)
                 .groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1"))
    return fit(docs.where(train), positives)


def accept(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch, s):
        return batch.filter(pa.array(shared.value.score(measures(s)) >= threshold))

    return T.map_slices(docs, run, docs.schema, text)
