"""Filter audit, vector codes and SimHash groups against plain versions, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
import xxhash

from transcript_lake.llm import filter_audit, simhash, vector_codes
from transcript_lake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# -- filter audit --------------------------------------------------------------------

#: Columns called like the operator's own results and inner names must not matter.
AUDIT_DOCS = "doc_id long, text string, source string, mask int, n long, kept string, id string, digest string"


def _audit_rows():
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    many = " ".join(f"v{i}" for i in range(250))
    texts = [None, "", many, many, "A" * 30, "a b c #", long, long, "é漢😀\x00", many + " |", "x " * 250, many.upper()]
    rows = [(i, t, ("s", None, "", "t")[i % 4], i, i, "k", "q", "z") for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[7], (None, many, "s", *[None] * 5), (None, None, None, *[None] * 5), (3, "a", "t", *[None] * 5)]


def _audit_plain(rows, labels):
    """Every order, applied left to right to the rows one after another."""
    tell = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, part, *_ in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((part or "", {f for f in fails if fails[f]}, tell(i, 1), tell(i, 2)))
    out, removed_at = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                removed_at[part, f] = removed_at.get((part, f), 0) + len(gone)
                out[part, order, step] = [len(kept), len(gone), sum(f in d[1] for d in own) - len(gone),
                                          sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = kept
    return {k: tuple([*v, removed_at[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def test_filter_audit_matches_plain_orders(spark):
    labels = [(0, 1, 0), (2, 1, 1), (2, None, 0), (3, 1, 0), (4, 0, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(_audit_rows(), AUDIT_DOCS)
    told = spark.createDataFrame([(*x, "u") for x in labels], "doc_id long, quality int, toxic int, mask string")
    got = filter_audit.audit(docs, told)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                           "good_lost", "toxic_lost", "shapley"]
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}
    assert got == _audit_plain(_audit_rows(), labels)
    none = filter_audit.audit(docs, None).where("good_lost + toxic_lost > 0")
    assert none.count() == 0
    assert filter_audit.audit(docs.limit(0), told).count() == 0


def test_path_counts():
    for k in range(1, 7):
        forward, backward = filter_audit.paths(k)
        assert forward[-1] == backward[0] == math.factorial(k)
        assert all(f == math.factorial(s.bit_count()) for s, f in enumerate(forward))
        at_size = {}
        for e in filter_audit.lattice(k):       # each order takes one edge from every size of state
            at_size[e["state"].bit_count()] = at_size.get(e["state"].bit_count(), 0) + e["weight"]
        assert set(at_size.values()) == {math.factorial(k)}


def test_filter_audit_of_own_filters(spark):
    own = {"short": lambda text, words: filter_audit.F.size(words) < 2, "same": filter_audit.DUPLICATE}
    docs = spark.createDataFrame([(1, "a", "p"), (2, "a", "p"), (3, "b c", "p")], "doc_id long, text string, source string")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley)
           for r in filter_audit.audit(docs, None, own).collect()}
    assert got == {("shortsame", 1): (1, 2, 0, 3), ("shortsame", 2): (1, 0, 1, 1),
                   ("sameshort", 1): (2, 1, 0, 1), ("sameshort", 2): (1, 1, 1, 3)}
    seven = {str(i): (lambda text, words: filter_audit.F.lit(False)) for i in range(7)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, None, seven)


# -- vector codes ---------------------------------------------------------------------

def test_orchard_search_matches_exhaustive_search():
    rng = np.random.default_rng(1)
    for size, width, spread in ((1, 3, 9), (2, 1, 2), (17, 2, 3), (64, 4, 6), (64, 4, 60), (256, 2, 200), (5, 0, 1)):
        entries = rng.integers(-spread, spread + 1, (3, size, width))
        entries[:, size // 2:] = entries[:, :size - size // 2]      # equal entries: the lower number wins
        x = rng.integers(-spread - 2, spread + 3, (400, 3, width))
        code, error = vector_codes.Codebooks(entries).nearest(x)
        gap = x[:, :, None, :] - entries[None]
        apart = (gap * gap).sum(3)
        assert (code == apart.argmin(2)).all() and (error == apart.min(2)).all()


def _compress_plain(rows, parts, entries, rounds):
    """Rows (id, vector, label) -> (id, code, error, label error, digest), in plain Python."""
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    firsts = {}
    for i, v, _ in ok:
        if i is not None and len(v) == len(ok[0][1]):
            firsts[i] = min(v, firsts.get(i, v))
    start = [firsts[i] for i in sorted(firsts)[:entries]]
    w = len(ok[0][1]) // parts
    cut = lambda v: [v[p * w:(p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for v in start] for p in range(parts)]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(b))
    fit = [r for r in ok if len(r[1]) == parts * w]
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in fit:
                held.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, lab in ok:
        if len(v) == parts * w:
            best = [near(x, b) for x, b in zip(cut(v), books)]
            out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
        else:
            out.append((i, None, None, lab))
    total = {}
    for _, _, e, lab in out:
        if e is not None:
            total[lab] = total.get(lab, 0) + e
    return [(i, c, e, total.get(lab), digest) for i, c, e, lab in out]


VECTORS = "vec_id long, embedding array<float>, label int, code string, id string, n long"


@pytest.mark.parametrize("entries", [64, 5])
def test_vector_codes_odd_rows(spark, entries):
    rng = random.Random(7)
    vec = lambda: [float(np.float32(rng.choice([0.0, 0.01, -0.3, rng.gauss(0, 1)]))) for _ in range(8)]
    rows = [(i, vec(), rng.choice([1, 2, None])) for i in range(120)]
    rows += [(200, None, 1), (201, [None, *[0.0] * 7], 1), (-5, [float("nan")] * 8, 1), (-6, [float("inf")] * 8, None),
             (202, [0.5] * 4, 3), (None, vec(), None), rows[3], (4, vec(), 2), (203, [], 1)]
    df = spark.createDataFrame([(*r, "c", "x", 1) for r in rows], VECTORS)
    got = vector_codes.compress(df, parts=4, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, _compress_plain(rows, 4, entries, 2)))


def test_vector_codes_empty_and_bad_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(none).count() == 0
    only = spark.createDataFrame([(None, [0.5] * 16, 1, "c", "x", 1)], VECTORS)
    (row,) = vector_codes.compress(only).collect()
    assert row.vec_id is None and row.code is None and row.error is None
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 10, 1, "c", "x", 1)], VECTORS))
    with pytest.raises(ValueError):
        vector_codes.compress(only, entries=300)


# -- SimHash ---------------------------------------------------------------------------

def _fingerprint_plain(text, n=4):
    w = WORDS.findall((text or "").translate(UP))
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups_plain(fps, radius=4):
    """Smallest vertex reachable, for vertices 0.. with these fingerprints."""
    a, least = np.array(fps, np.uint64), list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(a)):
            m = min(least[j] for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= radius))
            if m < least[i]:
                least[i], changed = m, True
    return least


def test_fingerprints_match_plain_python():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbé \n\t漢.\x00") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    texts += ["", "One", "a b c", "a b c d", " \n ", "x" * 50_000, " ".join(f"w{i % 977}" for i in range(20_000))]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [_fingerprint_plain(t) for t in texts]
    with pytest.MonkeyPatch.context() as m:             # hashed in several runs
        m.setattr(simhash, "_AT_ONCE", 7)
        assert [simhash.fingerprint(t.encode()) for t in texts] == [_fingerprint_plain(t) for t in texts]


@pytest.mark.parametrize("most, radius", [(1 << 21, 4), (3000, 4), (300, 2)])
def test_links_connect_all_that_are_near(spark, most, radius):
    """However few variants a task may hold, so however deep parts are divided."""
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = {0, 1, (1 << 64) - 1, centre} | {flip(centre, rng.randint(1, 7)) for _ in range(150)}
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain = flip(chain, radius)
        fps.add(chain)
    fps |= {flip(centre, radius + 1), *(rng.getrandbits(64) for _ in range(60))}
    fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    pairs = [tuple(r) for r in simhash.links(df, radius, most).collect()]
    assert all(((x ^ y) & (1 << 64) - 1).bit_count() <= radius for x, y in pairs)
    least = {x: x for x in signed}
    for _ in signed:
        for x, y in pairs:
            least[x] = least[y] = min(least[x], least[y])
    assert [least[x] for x in signed] == [signed[i] for i in _groups_plain(fps, radius)]


def test_a_task_never_holds_more_variants_than_asked():
    """The bound at full depth: a variant has no more holders than its ball has fingerprints."""
    centre = 0x0123456789ABCDEF
    all_near = np.array([centre ^ m for ms in simhash.flips(64, 2) for m in ms], np.uint64)
    lead = centre if centre < 1 << 63 else centre - (1 << 64)
    x, y = simhash.meetings(lead, all_near, 0, 2)
    assert len(all_near) == simhash.ball(64, 2) == 2081 and len(x) == 2080 and len(set(y.tolist())) == 1


def test_simhash_matches_plain_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [_fingerprint_plain(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", rows[g].doc_id) for r, f, g in zip(rows, fps, _groups_plain(fps))}
    got = QUERIES["op13_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [None, "", " \t\n ", "one", "One", "a b c", long, long + " ", "é漢😀 ß\x00\x0b", "!!! ### $$$"]
    rows = [(i, t, 0.5, "s", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "one", None, None, None), (None, None, None, None, None), (9, "other words", None, None, None)]
    kind = "doc_id long, text string, fingerprint double, component_id string, fp int"
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, kind)).collect(), key=repr)
    assert got[0].__fields__ == ["doc_id", "fingerprint", "component_id"] and len(got) == len(rows)
    of = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    plain = {(i, f"{_fingerprint_plain(t):016x}") for i, t, *_ in rows}
    assert set(of) == plain
    by_id = {i: of[i, f"{_fingerprint_plain(t):016x}"] for i, t, *_ in rows}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[3] == by_id[4] == 3 and by_id[6] == by_id[7] == 6
    assert by_id[None] is None and by_id[9] == 9
    assert {of[k] for k in of if k[0] == 9} == {9}          # both texts of the repeated id
    assert simhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)
