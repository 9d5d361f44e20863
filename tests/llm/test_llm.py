"""The numbered operators against brute force, their SQL and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from transcript_lake.llm import (decontaminate, line_dedup, ngram_join, packing, quality_pu, quality_rules, sharding,
                                 textvec, token_count, toxicity, url_filters)
from transcript_lake.llm.oracle import ORACLE
from transcript_lake.llm.queries import QUERIES, _tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, shard string, id string"


def _odd():
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [None, "", " \t\n ", "one", "a b c", "The same line of some length here\nx\n\nThe same line of some length here",
             "the same line of some length HERE ", "  the same line of some length here", long, long, "é漢😀 ß\x00\x0b",
             "x" * 50_000, "!!! ### $$$"]
    rows = [(i, t, None, 0.5, "s", "q") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "some words without an id", None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = sorted(QUERIES[key](spark, SF).columns)
    got = sorted(map(repr, map(tuple, QUERIES[key](spark, SF).select(cols).collect())))
    want = sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE[key]})").fetchall()))
    assert got == want


# -- words and shingles ----------------------------------------------------------

def test_words_and_shingles_match_python():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbé \n\t漢.") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "a " * 9]
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for s in textvec.slices(pa.array(texts), 500):
        rows, x = ngram_join.shingles(s, 4)
        sets += [set(x[rows == i].tolist()) for i in range(len(s))]
    seen = {}
    for t, have in zip(texts, sets):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(up))
        want = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
        assert len(want) == len(have)
        for h in have:
            seen.setdefault(h, set())
        if len(want) == 1:
            (h,), (g,) = have, want
            seen[h].add(g)
    assert all(len(v) <= 1 for v in seen.values())


def test_words_of_different_bytes_differ():
    words = [bytes([97, b, 98]).decode("latin-1") for b in range(128) if b not in b" \t\n\x0b\x0c\r"]
    (s,) = textvec.slices(pa.array([" ".join(words)]))
    h = s.words(textvec.WORDS)[3]
    assert len(h) == len(words) and len(set(h.tolist())) == len({w.lower() for w in words})


# -- classifiers -------------------------------------------------------------------

@pytest.mark.parametrize("key, folds, held", [("op1_toxicity", 4, 2), ("op4_quality", 5, 0)])
def test_scores_cover_all_documents(spark, key, folds, held):
    rows = QUERIES[key](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_ftrl_finds_marked_words():
    rng = random.Random(2)
    texts, y = [], []
    for i in range(3000):
        words = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(30)]
        y.append(int(i % 8 == 0))
        if y[-1]:
            words[rng.randrange(30)] = rng.choice(["badone", "badtwo"])
        texts.append(" ".join(words))
    feats = []
    for s in textvec.slices(pa.array(texts)):
        r, ids = toxicity._distinct_ids(s, 16)
        feats += [np.append(ids[r == i], 0) for i in range(len(s))]
    w = toxicity.ftrl(feats[:2000], y[:2000], 16)
    p = np.array([w[f].sum() for f in feats[2000:]])
    good = np.array(y[2000:]) == 1
    assert (p[good][:, None] > p[~good]).mean() > 0.97 and (w != 0).sum() < 2000


def _pu_rows(seed=3, n_good=2000, n_bad=400, n_mixed=1600):
    rng = np.random.default_rng(seed)
    n = len(quality_pu.FEATURES)
    good = rng.normal(0, 1, (n_good, n))
    bad = rng.normal(0, 1, (n_bad, n)) + np.r_[4.0, np.zeros(n - 1)]
    return good, np.concatenate([rng.normal(0, 1, (n_mixed, n)), bad]), bad


def test_positive_unlabelled_fit_and_prior():
    good, mixed, bad = _pu_rows()
    model = quality_pu.fit_arrays(good, mixed)
    assert 0.7 < model.prior < 0.92
    assert np.median(model.score(bad)) < 0.3 < np.quantile(model.score(good), 0.05)
    none = quality_pu.fit_arrays(good[:0], mixed)
    assert (none.score(mixed) == 0.5).all()


def _nn_pu_plain(cp, cu, n_weights, prior, steps=3000, rate=0.02):
    """The same penalised risk by Adam over all rows, row sums written out."""
    w, m, v = (np.zeros(n_weights + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    rows = lambda c: np.concatenate([np.eye(n_weights)[c].sum(1), np.ones((len(c), 1))], 1)
    xp, xu = rows(cp), rows(cu)
    best = np.inf
    for t in range(1, steps + 1):
        fp, fu = xp @ w, xu @ w
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        value = prior * np.logaddexp(0, -fp).mean() + max(0, rest) + quality_pu.L2 / 2 * (w[:-1] ** 2).sum()
        best = min(best, value)
        sig = lambda f: 1 / (1 + np.exp(-f))
        g = prior * ((sig(fp) - 1) @ xp) / len(xp)
        if rest > 0:
            g = g + sig(fu) @ xu / len(xu) - prior * (sig(fp) @ xp) / len(xp)
        g[:-1] += quality_pu.L2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return best


@pytest.mark.parametrize("prior", [0.6, 0.8, 0.9])
def test_descent_reaches_the_least_risk_of_a_plain_one(prior):
    good, mixed, _ = _pu_rows(5, 600, 120, 480)             # 0.8 is the share; above it the boundary binds
    model = quality_pu.fit_arrays(good, mixed, prior)
    cp, cu = model.codes(good), model.codes(mixed)
    w = np.append(model.weights, model.bias)
    value, _ = quality_pu.risk(w, cp, prior, np.logaddexp(0, w[cu].sum(1) + w[-1]).mean())
    assert value <= _nn_pu_plain(cp, cu, len(model.weights), prior) + 5e-3


def test_fit_uses_every_unlabelled_row(spark, monkeypatch):
    """Edges, prior and risk come from all rows, however few the samples hold."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(30, 90))) if i % 5 else " ".join(["#!# 123"] * rng.randint(5, 40)))
            for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = docs.where("doc_id % 5 <> 0 and doc_id % 2 = 0").select("doc_id")
    seen = []
    sums = quality_pu._sums
    monkeypatch.setattr(quality_pu, "_sums", lambda r, fn, size: seen.append(r.count()) or sums(r, fn, size))
    whole = quality_pu.fit(docs, good)
    assert set(seen) == {1500}
    small = quality_pu.fit(docs, good, max_rows=200)
    for a, b in zip(whole.edges, small.edges):
        assert np.array_equal(a, b)                         # the same corpus quantiles
    assert abs(whole.prior - small.prior) < 0.15 and 0.6 < whole.prior < 0.9
    bad = [r.score for r in quality_pu.score(docs, whole, "doc_id").where("doc_id % 5 = 0").collect()]
    fine = [r.score for r in quality_pu.score(docs, whole, "doc_id").where("doc_id % 5 <> 0").collect()]
    assert np.mean(np.array(bad) < 0.3) > 0.9 and np.mean(np.array(fine) >= 0.3) > 0.97


def test_fit_without_rows_or_positives(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, doc_text string")
    for docs, labels in ((empty, none), (odd, none), (empty, none.unionByName(none))):
        model = quality_pu.fit_labelled(docs, labels)
        assert all(r.score == 0.5 for r in quality_pu.score(docs, model, "doc_id").collect())
    one = spark.createDataFrame([(9, 1, "t"), (None, 1, "t"), (3, None, "t"), (3, 0, "t")], none.schema)
    assert quality_pu.score(odd, quality_pu.fit_labelled(odd, one), "doc_id").count() == len(_odd())


def test_scoring_odd_rows(odd, empty):
    w = np.zeros(1 << 10, np.float32)
    model = quality_pu.fit_arrays(np.random.default_rng(0).normal(size=(50, 15)), np.random.default_rng(1).normal(size=(50, 15)))
    for docs, n in ((odd, len(_odd())), (empty, 0)):
        assert toxicity.score(docs, w, "doc_id").count() == n
        assert quality_pu.score(docs, model, "doc_id").count() == n
        assert quality_pu.accept(docs, model, 0.0).count() == n


# -- rules, lines -------------------------------------------------------------------

def test_quality_rules_brute_force(spark, odd, empty):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))).replace("a b", "a\nb") for _ in range(150)]
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t, None, None, None, None) for i, t in enumerate(texts)], DOCS))
    for r in quality_rules.judge(docs).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {i + j for i in range(len(w) - 4) if win[tuple(w[i:i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.judge(empty).count() == 0


def test_line_dedup_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(odd).collect()}
    assert (5, 4, 2, "x\n") in got and (6, 1, 1, "") in got
    assert (7, 1, 0, "  the same line of some length here") in got          # the largest id keeps it
    assert (0, 1, 0, "") in got and (None, 1, 0, "some words without an id") in got
    assert line_dedup.dedup_lines(odd).columns[:6] == odd.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_keeps_the_corpus_own_columns(spark):
    long = "a line that is long enough to count"
    rows = [(i, f"{long}\nown {i}", "mine", "also mine") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_dropped string, n_lines_ string")
    got = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
    assert got[0].__fields__ == ["doc_id", "text", "n_dropped", "n_lines_", "n_lines", "n_dropped_"]
    assert [tuple(r)[2:] for r in got] == [("mine", "also mine", 2, 1)] * 2 + [("mine", "also mine", 2, 0)]
    kept = corpus_pipeline.lines(spark, docs.withColumn("n_chars", F.lit(99).cast("long")), None)
    assert kept.columns == [*docs.columns, "n_chars"]
    assert {(r.n_dropped, r.n_chars) for r in kept.collect()} == {("mine", 5), ("mine", 99)}


def test_line_dedup_brute_force_with_repeats(spark):
    rng = random.Random(12)
    pool = [f"shared line number {i} of the pool" for i in range(12)] + ["short", "", "  SHARED line number 3 of the pool "]
    rows = [(i // 2 if i % 5 == 0 else i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    held = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    gone = lambda i, x: len(held[key(x)]) >= 3 and i != max(held[key(x)]) if len(key(x)) >= 20 else False
    want = sorted((i, "\n".join(x for x in t.split("\n") if not gone(i, x)), len(t.split("\n"))) for i, t in rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_lines) for r in got) == want


def test_line_dedup_is_linear_in_a_text(spark):
    import time
    took = []
    for n in (8_000, 32_000):
        text = "\n".join(f"a line that many texts share {i % 4000}" for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
        line_dedup.dedup_lines(docs).count()
        t = time.perf_counter()
        got = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
        took.append(time.perf_counter() - t)
        assert [r.n_dropped for r in got] == [n, n, 0] and got[2].text == text
    assert took[1] < 4 * took[0] + 4                       # quadratic: sixteen times as long, minutes


# -- tiling ---------------------------------------------------------------------------

def _tiling(d, b, k):
    free_d, free_b, covered = [True] * len(d), [True] * len(b), 0
    while True:
        best, found = 0, []
        for i in range(len(d)):
            for j in range(len(b)):
                n = 0
                while i + n < len(d) and j + n < len(b) and d[i + n] == b[j + n] and free_d[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if best < k:
            return covered
        for i, j in found:
            if all(free_d[i:i + best]) and all(free_b[j:j + best]):
                free_d[i:i + best] = free_b[j:j + best] = [False] * best
                covered += best


def test_tiling_matches_exhaustive_search():
    rng = random.Random(5)
    for _ in range(120):
        b = rng.sample(range(1, 200), rng.randint(4, 40))           # distinct words: no ties
        cuts = sorted(rng.sample(range(len(b) + 1), min(3, len(b))))
        parts = [b[i:j] for i, j in zip([0, *cuts], [*cuts, len(b)])]
        rng.shuffle(parts)
        d = [x for p in parts for x in [*p, 900 + rng.randint(0, 50)]]
        got = decontaminate.tile([np.array(d, np.uint64)], np.array(b, np.uint64), 3)[0]
        assert got == _tiling(d, b, 3)


def test_tiling_with_repeats_and_ties():
    rng = random.Random(15)
    for n in range(150):
        words = rng.choice([1, 2, 3, 6])
        b = [rng.randint(1, words) for _ in range(rng.randint(4, 40))]
        d = [rng.choice([rng.randint(1, words), 99]) if rng.random() < 0.3 else rng.choice(b) for _ in range(rng.randint(0, 70))]
        cut = rng.randint(0, len(d))
        d[cut:cut] = b[:rng.randint(0, len(b))]
        if not d:
            continue
        covered, tiles = decontaminate.tile([np.array(d, np.uint64)], np.array(b, np.uint64), 3)
        assert covered == _tiling(d, b, 3), n


def test_tiling_of_one_repeated_word_is_fast():
    import time
    item, doc = np.full(2000, 7, np.uint64), np.full(8000, 7, np.uint64)
    doc[::701] = 8
    t = time.perf_counter()
    covered, tiles = decontaminate.tile([doc], item, 4)
    assert covered == 2000 and tiles == 3 and time.perf_counter() - t < 5


def test_shared_openings_and_equal_items():
    import time
    opening = " ".join(f"o{i}" for i in range(60))
    texts = [f"{opening} {' '.join(f'x{k}y{j}' for j in range(20))}" for k in range(400)] + [f"{opening} again"] * 3
    block = decontaminate.Block(list(range(len(texts))), texts, 4)
    (s,) = textvec.slices(pa.array([f"before {opening} after", "nothing of it", texts[0]]))
    t = time.perf_counter()
    hits = block.pairs(s, 0.5, first=True)
    assert [h[0] for h in hits] == [0, 2] and time.perf_counter() - t < 1
    every = block.pairs(s, 0.5)
    assert len(every) == 2 * len(texts) and {h[1] for h in every if h[0] == 0} == set(range(len(texts)))


def test_contaminated_pairs_and_blocks(spark, odd, empty):
    item = "alpha beta gamma delta. Epsilon zeta eta theta. Iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    docs = odd.unionByName(spark.createDataFrame(
        [(50, f"words before {item.upper()} after", None, None, None, None),
         (51, "iota kappa lambda mu and epsilon zeta eta theta, alpha beta gamma delta", None, None, None, None),
         (52, "alpha beta gamma other kappa lambda mu", None, None, None, None)], DOCS))
    want = {(50, 1), (51, 1), (8, 4), (9, 4)}
    for size in (decontaminate.BLOCK_BYTES, 10):
        got = decontaminate.contaminated_pairs(docs, bench, block_bytes=size)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
        kept = decontaminate.drop_contaminated(docs, bench, block_bytes=size)
        assert kept.count() == docs.count() - 4 and kept.columns == docs.columns
    assert decontaminate.contaminated_pairs(empty, bench).count() == 0
    assert decontaminate.contaminated_pairs(docs, bench.limit(0)).count() == 0


# -- similarity join --------------------------------------------------------------------

@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, odd, n, percent):
    rng = random.Random(6)
    rows = []
    for g in range(12):                                         # groups of edited copies round a shared passage
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([6, 7, 20, 60, 150]))] + ["common"] * 3
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 999)}"
            rows.append((1000 + len(rows), " ".join(w), None, None, None, None))
    docs = odd.unionByName(spark.createDataFrame(rows, DOCS))
    sets, up = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in {(r[0], r[1]) for r in docs.select("doc_id", "text").collect() if r[0] is not None}:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    got = ngram_join.near_duplicates(docs, n, percent).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id))
        assert r.doc_id is None or r.n_shingles == len(sets[r.doc_id])


def test_rows_of_one_group_never_meet(spark):
    m, size = 200, 20                                           # one group of copies, a document that shares four shingles and one that shares two
    rows = [(i, size, at, at) for i in range(m) for at in range(4)]
    rows += [(500, size, at, at) for at in range(4)] + [(600, size, at, at) for at in range(2)]
    shared = spark.createDataFrame(rows, "id long, size long, at int, token long")
    groups = spark.createDataFrame([(i, 0) for i in range(m)], "id long, component long")
    parities = shared.select("id", *[F.lit(0).cast("long").alias(b) for b in ngram_join.PARITY]).distinct()
    got = ngram_join.group_pairs(shared, groups, parities, 85)
    assert {(r.x, r.y) for r in got.collect()} == {(i, 500) for i in range(m)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any(re.search(r"gx#\d+L? < gy#\d+L?", line) for line in joins)


def test_a_large_group_is_not_repeated_for_its_partners(spark):
    m, partners, size = 300, 120, 20
    rows = [(1, 2, i, 0, size, 0, 1, *[0] * 4) for i in range(m)]
    rows += [(1, 2, 1000 + i, 1000 + i, size, 0, 1, *[-1] * 4) for i in range(partners)]   # parities rule them out
    rows += [(1, 2, 5000, 5000, size, 0, 1, *[0] * 4)]
    index = spark.createDataFrame(rows, "t1 long, t2 long, id long, g long, size long, at long, later long, "
                                  + ", ".join(f"{b} long" for b in ngram_join.PARITY))
    key = ["t1", "t2"]
    meets = ngram_join._meets(index, key, 85, 2)
    assert {r.gx for r in meets.where("gy >= 1000 and gx < 1000").collect()} == {0}     # the larger group is gx
    few = meets.join(index.withColumnRenamed("g", "gy"), [*key, "gy"])
    assert few.count() == meets.count() <= (partners + 1) * (partners + 2) // 2         # no factor m
    assert not meets.where("gx = 5000 or gy = 5000").where("gx >= 1000 and gy >= 1000").count()   # single rows, not alike
    got = ngram_join._across(index, meets, key, 85, 2).collect()
    among = partners * (partners - 1) // 2                                              # alike among themselves
    assert len(got) == m + among and {(r.x, r.y) for r in got if r.x < m} == {(i, 5000) for i in range(m)}


@pytest.mark.parametrize("frequent", [0, 1, 2, ngram_join.FREQUENT])
def test_near_duplicates_frequent_shingles(spark, monkeypatch, frequent):
    rng = random.Random(10)
    passage, texts = [f"p{i}" for i in range(30)], []
    for g in range(60):                                         # short documents of many groups share a passage
        own = [f"g{g}x{i}" for i in range(rng.choice([2, 3, 4, 5, 6]))]
        for _ in range(3):
            w = passage + own
            for _ in range(rng.choice([0, 0, 1])):
                w[rng.randrange(4)] = f"e{rng.randint(0, 5)}"
            texts.append(w)
    for _ in range(8):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([20, 60]))]
        for _ in range(15):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 999)}"
            texts.append(w)
    rng.shuffle(texts)
    sets = [{tuple(w[k:k + 4]) for k in range(len(w) - 3)} for w in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    paired, across = [], ngram_join._across

    def seen(index, meets, key, *rest):
        if len(key) == 2:
            paired.append(index.count())
        return across(index, meets, key, *rest)

    monkeypatch.setattr(ngram_join, "_across", seen)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = ngram_join.near_duplicates(docs, 4, 85, frequent=frequent).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(texts))}
    assert paired[0] > 0                                        # the index of pairs was reached


def test_near_duplicates_empty(empty):
    assert ngram_join.near_duplicates(empty).count() == 0


# -- packing, counting, sharding -----------------------------------------------------------

def test_best_fit_plan_is_best_fit_decreasing():
    rng = random.Random(7)
    for _ in range(100):
        window = rng.choice([8, 16, 37])
        sizes = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
        rooms, bins = [], defaultdict(list)
        for s in sorted(sizes, reverse=True):
            fit = [i for i, r in enumerate(rooms) if r >= s]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(window - s)
        for s, _, n, q, first, off in packing.best_fit_plan(dict(Counter(sizes)), window):
            for k in range(n):
                bins[first + k // q].append((off + k % q * s, s))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(s for _, s in b[:i]) for i in range(len(b))]
        assert sorted(window - sum(s for _, s in b) for b in bins.values()) == sorted(rooms)


def test_packing_round_trip(odd, empty):
    from tokenizers import Tokenizer

    path = _tokenizer("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    got = packing.pack(odd, path, 64).collect()
    docs, windows = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 64
        docs[r.doc_id, r.doc_tokens].append((r.start, ids))
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:i]) for i in range(len(w))] and sum(n for _, n in w) <= 64
    for i, t, *_ in _odd():
        want = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = dict(docs[i, len(want)])
        assert i is None or [x for s in sorted(pieces) for x in pieces[s]] == want
    assert packing.pack(empty, path).count() == 0


def test_packing_added_tokens(spark):
    from tokenizers import Tokenizer

    path = _tokenizer("byte_bpe_50k.json")
    slow, end = Tokenizer.from_file(path), "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x \n {end}\n  y", "a <|endoftext| > b", f"é{end}漢 " * 200]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)], DOCS)
    pieces = defaultdict(dict)
    for r in packing.pack(docs, path, 64).collect():
        pieces[r.doc_id, r.doc_tokens][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    for i, t in enumerate(texts):
        want = [*slow.encode(t, add_special_tokens=False).ids, 0]
        assert [x for s in sorted(pieces[i, len(want)]) for x in pieces[i, len(want)][s]] == want
    assert packing.encoder(path)(texts[0]) == [64, 220, 50256, 275]


def test_token_counts_match_library(odd, empty):
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = _tokenizer("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab = [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]
    ref = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    unigram, rng = token_count.load(path), random.Random(8)
    texts = ["".join(rng.choice(" ab\nthe▁éñß漢😀 .,12\t") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for t in texts:
        want = len(ref.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
        assert unigram.tokens(t) == want == (unigram.viterbi("▁" + t.replace(" ", "▁")) if t else 0)
    assert token_count.count_tokens(odd, path, "doc_id").count() == len(_odd())
    assert token_count.count_tokens(empty, path, "doc_id").count() == 0


@pytest.mark.parametrize("part_bytes", [1 << 26, 3000])
def test_shards(spark, odd, empty, part_bytes):
    rng = random.Random(9)
    rows = [(100 + i, "hot text" * 9 if i % 3 == 0 else "t" * rng.randint(0, 90) + str(i), None, None, None, None) for i in range(900)]
    docs = odd.unionByName(spark.createDataFrame(rows, DOCS))
    got = sharding.shard(docs, 4, part_bytes=part_bytes).collect()
    assert len(got) == docs.count()
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == str(s) or r.shard == s) == list(
            range(sum(1 for r in got if r.shard == s)))
    small = spark.createDataFrame(rows, DOCS)
    sizes = Counter()
    for r in sharding.shard(small, 4, part_bytes=part_bytes).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 400
    assert sharding.shard(empty).count() == 0


def test_small_parts_add_no_cuts_and_keep_every_row(spark, monkeypatch):
    rows = [(i, "hot text" * 9 if i % 3 == 0 else f"text {i}") for i in range(1200)] + [(None, "hot text" * 9)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Shard.of", F.lit(1))
    asked, plain = [], sharding.splitters
    monkeypatch.setattr(sharding, "splitters", lambda keys, shares, *a: asked.append(len(shares)) or plain(keys, shares, *a))
    big, small = (sharding.shard(docs, 4, part_bytes=b).collect() for b in (1 << 26, 200))
    assert asked == [3, 3]                          # hundreds of parts, the same three boundaries
    assert Counter((r.doc_id, r.text, r.shard) for r in big) == Counter((r.doc_id, r.text, r.shard) for r in small)
    for s in range(4):
        assert sorted(r.slot for r in small if r.shard == s) == list(range(sum(r.shard == s for r in small)))


# -- urls -------------------------------------------------------------------------------------

def test_url_rules_and_graph(spark):
    rows = [(1, "https://A.Example.com/en/x", None), (2, "http://www.example.com/en/", ""), (3, "http://x.net/es/1", None),
            (4, "http://y.org/a", '<a href="http://x.net/es/">'), (5, "http://z.org?q", "<img src='//good.com/i.png'>"),
            (6, None, None), (7, "no scheme", None), (8, "http://notcom/", None), (9, "http://x.com", None),
            (10, "http://good.com/a", '<a href="https://z.org/">'), (None, "http://com/#f", None), (1, "https://A.Example.com/en/x", None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(
        spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("trust", F.lit("t"))).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("net/es/", "block")
    assert got[4][2:] == (None, "block")            # links to a blocked host
    assert got[5] == ("z.org", "", None, "allow")    # linked from an allowed host
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2] is None and got[9] == ("x.com", "", None, "allow") and got[None][2:] == ("com/", "allow")
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- pipeline -----------------------------------------------------------------------------------

def test_pipeline_stages(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns and out.count() > 0.5 * docs.count()
            docs = out
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    for rows in (odd, empty):
        docs = rows.select("doc_id", "text", "lang", "id")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
        assert (docs.count() > 0) == (rows is odd)


def test_near_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"v{i}" for i in range(120))
    rows = [(3, base), (1, base), (2, base.replace("v50 ", "q ")), (9, "another text altogether " * 3), (None, base)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "9", "None"]


def test_kept_text_hash(spark):
    rows = QUERIES["op8_line_dedup"](spark, SF).where("n_dropped = 0").limit(1).collect()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == rows[0].doc_id).first().text
    assert rows[0].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_clashing_columns_are_kept_with_an_underscore(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 7, "x"), (2, None, None, None, None)],
                                 "doc_id long, text string, size string, Shard int, slot_ string")
    got = {r.doc_id: r for r in sharding.shard(docs, 2).collect()}
    assert got[1].size_ == "mine" and got[1].Shard_ == 7 and got[1].slot_ == "x" and got[1].size == 4 and got[2].size == 1
    pages = spark.createDataFrame([(1, "http://a.com/x", None, "mine", 0.5)],
                                  "page_id long, url string, html string, trust string, host double")
    (row,) = url_filters.judge(pages).collect()
    assert row.trust_ == "mine" and row.host_ == 0.5 and row.host == "a.com" and row.verdict == "allow"


def test_ftrl_weights_from_tables_match_the_plain_loop(spark):
    """A plain per-row FTRL over dictionaries, in the same order of rows."""
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12))), int(rng.random() < 0.4)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = toxicity.fit(df, bits=12)
    order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows.sort(key=lambda r: order[r[0]])
    feats = []
    for _, t, y in rows:
        (s,) = textvec.slices(pa.array([t]))
        feats.append((np.append(toxicity._distinct_ids(s, 12)[1], toxicity._BIAS), y))
    want = toxicity.ftrl([f for f, _ in feats], [y for _, y in feats], 12)
    assert np.allclose(got, want, atol=1e-6) and (got != 0).any()


def test_sharding_columns_match_plain_python(spark):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "é" * (i % 11) + "x" * (i % 5)) for i in range(200)],
                                 "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard(docs, 8).collect()
    of = defaultdict(list)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        of[r.shard].append(r)
    total = sum(r.size for r in rows)
    for k in range(8):
        assert sorted(r.slot for r in of[k]) == list(range(len(of[k])))
    most = max(r.size for r in rows)
    below = 0
    for k in range(7):                                          # each boundary within a row of its share
        below += sum(r.size for r in of[k])
        assert abs(below - total * (k + 1) / 8) <= most
