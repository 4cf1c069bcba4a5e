"""Spelling variants, MinHash near-duplicates and periodic runs against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.llm import minhash, periodic, spelling
from lagweave.llm.shared import staged

from .test_operators import SCHEMA, brute_components, in_order, shingles, words


def table_of(spark, rows, parts=3):
    return staged(spark.createDataFrame([(i, t, "en", "s", "r", "m", "k") for i, t in rows], SCHEMA).repartition(parts), "t")


# --- spelling variants -------------------------------------------------------------------------


def brute_counts(rows, noise, shortest=7, least=2):
    n = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "")):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, ratio=10):
    form, count = {}, {}
    for w in n:
        by = sorted((-n[v], v) for v in n if v != w and near(v, w))
        count[w] = len(by)
        form[w] = by[0][1] if by and -by[0][0] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n.get(form[w])))
    return out


@pytest.fixture(scope="module")
def spelled(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdeéÀÉ×ÿ") for _ in range(r.randint(7, 11))) for _ in range(25)]
    rows = []
    for i in range(300):
        text = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.3)), 24)]
            for _ in range(r.choice([0, 0, 0, 0, 0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcdeé") + w[k:], w[:k] + r.choice("abcdeé") + w[k + 1 :]])
            text.append(w.upper() if w.isascii() and r.random() < 0.1 else w)
        rows.append((None if i % 50 == 0 else i // 2, r.choice([" ", "-", "\n", "١"]).join(text)))
    long = "abcdefghij" * 400
    rows += [(1, None), (2, ""), (3, "short 123"), (4, "ĀbcdefgĀ ab̀cdefgh"), (5, f"{long} {long}x {long} {long}x {long[:2000]}q{long[2001:]} {long[:2000]}q{long[2001:]}")]
    return rows


@pytest.mark.parametrize("noise, tile_words", [(None, 1024), (31, 3), (2, 40)])
def test_spelling_variants(spark, spelled, noise, tile_words):
    got = spelling.variants(table_of(spark, spelled), noise=noise, tile_words=tile_words, tile_letters=20_000)
    want = brute_variants(brute_counts(spelled, noise))
    assert in_order(map(tuple, got.collect())) == in_order(want)
    assert any(x[1] for x in want) and any(x[2] != x[1] and x[1] for x in want) == any(x[1] and x[2] != x[1] for x in want)


def test_spelling_chains_and_ties(spark):
    counts = {"aaaaaaa": 1000, "aaaaaab": 100, "aaaaabb": 10, "bbbbbbbb": 40, "bbbbbbbc": 40, "bbbbbbb": 4, "cccccccc": 3}
    rows = [(1, " ".join(w for w, k in counts.items() for _ in range(k)))]
    got = {r.word: r for r in spelling.variants(table_of(spark, rows, 1)).collect()}
    assert {w: r.n for w, r in got.items()} == counts
    assert got["aaaaabb"].root == "aaaaaaa" and got["aaaaabb"].form == "aaaaaab"
    assert got["bbbbbbb"].form == "bbbbbbbb" and got["bbbbbbb"].n_near == 2  # the smaller of two that tie
    assert got["cccccccc"].form is None and got["cccccccc"].root == "cccccccc" and got["cccccccc"].n_near == 0


def test_spelling_empty(spark):
    assert spelling.variants(table_of(spark, [])).collect() == []
    assert spelling.variants(table_of(spark, [(1, None), (None, "")])).collect() == []


def test_crc_of_spans():
    r = random.Random(4)
    spans = [bytes(r.randrange(256) for _ in range(r.randint(1, 40))) for _ in range(500)]
    data, end = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    start = end - [len(s) for s in spans]
    seeds = [zlib.crc32(str(i).encode()) for i in range(500)]
    got = spelling._crc(data, start, end, np.array(seeds, np.uint32))
    assert got.tolist() == [zlib.crc32(s, c) for s, c in zip(spans, seeds)]


# --- MinHash -----------------------------------------------------------------------------------


def edited(r, w, share):
    return [r.choice("qwertzuiop") + str(r.randrange(999)) if r.random() < share else x for x in w]


@pytest.fixture(scope="module")
def copies(spark):
    r = random.Random(5)
    vocab = [a + b for a in "bcdfg" for b in ("a", "e", "io", "ul", "st")]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    rows = []
    for _ in range(12):
        base = make(r.randint(30, 300))
        for _ in range(r.randint(2, 14)):
            rows.append(" ".join(edited(r, base, r.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2]))))
    rows += [" ".join(make(200)) for _ in range(30)] + [None, "", " \n", "one", "ONE", "one two", "one two three", "One  Two three"] + ["same text of a few words " * 9] * 20
    r.shuffle(rows)
    return [(None if i % 17 == 0 else i // 2 if i % 3 == 0 else i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k, similarity, tile", [(4, (80, 100), 512), (2, (90, 100), 3)])
def test_minhash_components(spark, copies, k, similarity, tile):
    sets = {j: shingles(t, k) for j, (_, t) in enumerate(copies)}
    groups, _ = brute_components(sets, *similarity)
    least = {}
    for j, (i, _) in enumerate(copies):
        if i is not None:
            least[groups[j]] = min(i, least.get(groups[j], i))
    want = []
    for j, (i, _) in enumerate(copies):
        name = least.get(groups[j]) if sets[j] else i
        want.append((i, len(sets[j]), name, i == name))
    got = minhash.minhash_duplicates(table_of(spark, copies), k, similarity, tile=tile)
    assert in_order(map(tuple, got.collect())) == in_order(want)


def test_minhash_needs_follow_the_posterior():
    r = random.Random(6)
    needs = minhash.least_matches((80, 100), 1e-3)
    lost = 0
    for _ in range(4000):
        equal = list(itertools.accumulate(r.random() < 0.8 for _ in range(minhash.HASHES)))
        lost += any(equal[n - 1] < m for n, m in needs)
    assert lost <= 4000 * 1e-3 * len(needs) + 12
    assert all(a[1] >= b[1] for a, b in zip(needs, minhash.least_matches((80, 100), 1e-6)))


def test_minhash_estimates_similarity():
    r = np.random.default_rng(7)
    a = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:700], r.integers(0, 1 << 63, 300).astype(np.uint64)])
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 1000, 2000]))
    assert abs((s[0] == s[2]).mean() - 700 / 1300) < 0.13 and not s[1].any()


def test_minhash_odd(spark):
    assert minhash.minhash_duplicates(table_of(spark, [])).collect() == []
    got = minhash.minhash_duplicates(table_of(spark, [(None, None), (3, "")]), 4)
    assert in_order(map(tuple, got.collect())) == in_order([(None, 0, None, True), (3, 0, 3, True)])
    boiler = " ".join(f"w{i}" for i in range(60))
    many = table_of(spark, [(None, boiler)] * 3000 + [(9, boiler)])
    assert [tuple(r) for r in minhash.minhash_duplicates(many).groupBy("component_id", "kept").count().collect()] in ([(9, False, 3000), (9, True, 1)], [(9, True, 1), (9, False, 3000)])


# --- periodic runs -----------------------------------------------------------------------------


def brute_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                s = w[i : i + size]
                if not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def replaced(i, w):
    h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(w)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    return w


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def periodic_rows():
    r = random.Random(8)
    rows = []
    for i in range(250):
        w = []
        while r.random() < 0.75 and len(w) < 400:
            p = [r.choice(["a", "b", "é", "no", "Yes"][: r.choice([1, 2, 5])]) for _ in range(r.randint(1, 30))]
            w += (p * 30)[: r.randint(1, 150)]
        rows.append((None if i % 40 == 0 else i // 2 if i % 9 == 0 else i, r.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "x " * 5000), (1004, "x y " * 3000 + "z"), (1005, " ".join(f"w{k % 1999}" for k in range(6100)))]
    return rows


def test_periodic_runs(spark, periodic_rows):
    want, plain = [], []
    for i, t in periodic_rows:
        for planted, out in ((True, want), (False, plain)):
            w = replaced(i, words(t)) if planted else words(t)
            runs = brute_runs(w) if len(w) < 2500 else brute_long(w)
            gone = {k for a, n, q in runs for k in range(a + q, a + n)}
            kept = " ".join(x for k, x in enumerate(w) if k not in gone)
            best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
            if planted:
                out.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(kept)))
            else:
                out.append((i, [tuple(x) for x in runs], kept))
    docs = table_of(spark, periodic_rows)
    assert in_order(map(tuple, periodic.periodic_runs(docs, planted=True, digest=True).collect())) == in_order(want)
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()]
    assert in_order(got) == in_order(plain)
    assert sum(x[1] > 0 for x in want) > 60


def brute_long(w):
    """brute_runs for long texts of few runs: numpy compares all words one distance apart."""
    ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
    v, out = np.array([ids[x] for x in w]), []
    for q in range(1, len(v) // 3 + 1):
        same = np.concatenate([[0], v[q:] == v[:-q], [0]]).astype(np.int8)
        lo, hi = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(lo.tolist(), hi.tolist()):
            if b - a + q >= max(24, 3 * q):
                s = v[a : b + q]
                if not any((s[d:] == s[:-d]).all() for d in range(1, q)):
                    out.append((a, b - a + q, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_periodic_empty(spark):
    assert periodic.periodic_runs(table_of(spark, [])).collect() == []


@pytest.mark.parametrize("least, times", [(24, 3), (2, 3), (10, 4)])
def test_runs_of_random_words(least, times):
    r = random.Random(9)
    for _ in range(300):
        texts = [[r.randint(0, r.choice([0, 1, 2])) for _ in range(r.randint(0, 60))] for _ in range(3)]
        at = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        got = periodic.runs_of_words(np.array([x for w in texts for x in w], np.int64), at, least, times)
        want = [(i, *x) for i, w in enumerate(texts) for x in brute_runs(w, least, times)]
        assert list(zip(*(x.tolist() for x in got))) == want


# --- the registered queries --------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op7_ngram_join", "op11_spelling_variants", "op12_minhash_dedup"])
def test_queries_equal_sql(spark, name):
    from lagweave.llm import registry

    where = "/root/testdata/sf0.001"
    df = registry.QUERIES[name](spark, where)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    assert in_order(map(tuple, df.collect())) == in_order(c.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.SQL[name]}) AS q").fetchall())


def test_op13_on_the_given_table(spark):
    where = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    got = {r.doc_id: r for r in periodic.op13(spark, where).collect()}
    assert got.keys() == rows.keys()
    for i, t in rows.items():
        runs = brute_long(replaced(i, words(t)))
        assert got[i].n_runs == len(runs) and got[i].runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs))


def test_extra_columns_are_ignored(spark):
    docs = table_of(spark, [(1, "x " * 40), (2, "y")]).withColumns({c: F.lit("z") for c in ("n", "word", "node", "key", "signature", "band", "period", "block")})
    assert periodic.periodic_runs(docs).count() == 2 and minhash.minhash_duplicates(docs).count() == 2
    assert spelling.variants(docs).count() == 0
