"""Repeated rows, rules and n-grams beyond former caps, and results against plain scorers."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lagweave.llm import language, mixing, ngram_join, quality, substring_dedup, url_filter
from lagweave.llm.shared import staged

from .test_operators import SCHEMA, in_order, words


def table_of(spark, rows, parts=3):
    return staged(spark.createDataFrame([(i, t, "en", "s", "r", "m", "k") for i, t in rows], SCHEMA).repartition(parts), "t")


# --- rows alike ----------------------------------------------------------------------------------


def test_ten_thousand_rows_alike(spark):
    text = " ".join(f"w{k % 97}x{k}" for k in range(120))
    docs = table_of(spark, [(1, text)] + [(None, text)] * 10_000 + [(2, "tail " + text)])
    got = substring_dedup.remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert in_order(map(tuple, got)) == in_order([(1, 120, 0, 1), (None, 120, 120, 10_000), (2, 121, 120, 1)])
    near = ngram_join.near_duplicates(docs).groupBy("component_id").count().collect()
    assert [tuple(r) for r in near] == [(1, 10_002)]
    assert ngram_join.keep_one(docs).count() == 1
    queue, served = mixing.fair_mix(docs)
    assert queue.count() == 10_002 and abs(served.agg({"words": "sum"}).first()[0] - 1.5 * (120 * 10_001 + 121)) < 1


def test_rows_alike_among_others(spark):
    """Null ids, repeated ids and repeated rows against a plain loop."""
    r = random.Random(21)
    vocab = [f"v{k}" for k in range(400)]
    parts = [" ".join(r.choice(vocab) for _ in range(n)) for n in (55, 70, 90)]
    rows = []
    for i in range(40):
        t = " ".join(r.choice([r.choice(parts), " ".join(r.choice(vocab) for _ in range(20))]) for _ in range(r.randint(1, 4)))
        rows += [(r.choice([None, i, i // 3]), t)] * r.choice([1, 1, 3])
    no, first = 1 << 62, {}
    for i, t in sorted(rows, key=lambda x: no if x[0] is None else x[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), no if i is None else i)
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (no if i is None else i):
                gone.update(range(k, k + 50))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    for bits in (64, 6):
        assert in_order(map(tuple, substring_dedup.remove_repeats(table_of(spark, rows), hash_bits=bits).collect())) == in_order(want)


# --- URL rules without a width -------------------------------------------------------------------


def wide_pages(extra):
    """Unwanted pages share extra common tokens that good pages have as well; x and y together are
    on unwanted pages alone, each of them on many good ones."""
    rows, r = [], random.Random(22)
    for i in range(300):
        bad = i % 2 == 0
        tokens = [f"c{k:02d}" for k in range(extra) if r.random() < (0.95 if bad else 0.3)]
        if bad and i % 4 == 0:
            tokens += ["x", "y"]
        elif not bad:
            tokens += ["x"] if i % 4 == 1 else ["y"]
        rows.append((i, tokens, bad))
    return rows


@pytest.mark.parametrize("extra", [10, 14])
def test_a_rule_behind_many_common_tokens(spark, extra):
    labeled = spark.createDataFrame(wide_pages(extra), "row long, tokens array<string>, unwanted boolean")
    rules = {tuple(r["items"]): r.confidence for r in url_filter.mined_rules(labeled, support=0.2, confidence=0.5)[1].collect()}
    assert rules.get(("x", "y")) == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_of_mining_agree(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(250):
        tokens = [t for t in "abcdefg" if r.random() < 0.5] + (["h", "i"] if r.random() < 0.4 else [])
        rows.append((i, tokens, ("a" in tokens and "b" in tokens) or r.random() < 0.3))
    labeled = spark.createDataFrame(rows, "row long, tokens array<string>, unwanted boolean")
    ways = [{tuple(x["items"]): (x.confidence, x.support) for x in url_filter.mined_rules(labeled, 0.02, 0.3, 5, width=w)[1].collect()} for w in (30, 0)]
    assert ways[0] == ways[1] and any(len(c) > 2 for c in ways[0])
    # no rule has a part, however small, that is at least as sure
    for a in ways[0]:
        assert not any(set(b) < set(a) and ways[0][b][0] >= ways[0][a][0] for b in ways[0])


# --- languages -----------------------------------------------------------------------------------


def plain_grams(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    low = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 0 for b in low)
    for size in language.SIZES:
        for k in range(len(low) - size + 1):
            g = low[k : k + size]
            if 0 not in (g if size < 3 else g[1:-1]):
                yield size, g


def plain_model(rows):
    n, total = Counter(), Counter()
    for text, lang in rows:
        for g in plain_grams(text or ""):
            n[lang, g] += 1
            total[lang, g[0]] += 1
    rate = {k: v / total[k[0], k[1][0]] for k, v in n.items()}
    top = {}
    for (lang, g), x in rate.items():
        top[g] = max(top.get(g, 0), x)
    return {k for k, v in n.items() if v >= language.LEAST and rate[k] >= language.RATIO * top[k[1]]}


def test_language_scores_against_sets(spark):
    """The filter's scores are those of plain sets, but for what chance leaves."""
    r = random.Random(23)
    pools = {x: ["".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(60)] for x, a in {"aa": "abcdeiou", "bb": "abcklmno", "cc": "stuvabcé"}.items()}
    rows = [(i, " ".join(r.choice(pools[x]) for _ in range(40)), x) for i, x in enumerate(r.choice(list(pools)) for _ in range(120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.trained(docs.where("doc_id % 5 != 0"))
    has, names = plain_model([(t, x) for i, t, x in rows if i % 5]), sorted(pools)
    got = {x.doc_id: x for x in language.identified(docs.where("doc_id % 5 = 0"), model).collect()}
    for i, text, lang in rows:
        if i % 5 == 0:
            grams = list(plain_grams(text))
            share = [sum((x, g) in has for g in grams) / len(grams) for x in names]
            assert abs(got[i].score - max(share)) < 0.02
            if sorted(share)[-1] - sorted(share)[-2] > 0.04:
                assert got[i].lang_pred == names[int(np.argmax(share))]
    assert sum(got[i].lang_pred == x for i, _, x in rows if i % 5 == 0) >= 22


def test_every_distinctive_ngram_is_kept(spark):
    """A language with far more than 20,000 of them: all are in the filter, which grows with them."""
    counts = spark.range(50_000).selectExpr("'big' AS lang", "4 AS size", "xxhash64(id) AS gram", "7L AS n").unionByName(spark.range(10).selectExpr("'small' AS lang", "4 AS size", "xxhash64(id) AS gram", "9L AS n"))
    kept = language.distinctive(counts).groupBy("lang").count().collect()
    assert dict(map(tuple, kept))["big"] >= 49_990
    grams = np.arange(400_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    model = language.LanguageModel(["big", "small"], len(grams))
    model.add(grams, 0)
    assert (model.filters[0].masks(grams) == 1).all() and model.filters[0].fill()[0] < 0.02


def test_held_out_accuracy_on_the_given_table(spark):
    where = "/root/testdata/sf0.001"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    got = [r for r in language.op8(spark, where).collect() if r.held_out and lang[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.9 * len(got)


# --- the quality operator's own columns ------------------------------------------------------------


def test_quality_columns_of_repetition(spark):
    r = random.Random(24)
    vocab = [f"k{n}" for n in range(9)]
    rows = []
    for i in range(60):
        lines = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 12))]
        rows.append((i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 20)))))
    got = {x.doc_id: x for x in quality.repetition_rules(table_of(spark, rows)).collect()}
    for i, t in rows:
        w = words(t)
        for size in (5, 10, 20):
            at = {}
            for k in range(len(w) - size + 1):
                at.setdefault(tuple(w[k : k + size]), []).append(k)
            inside = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + size)}
            assert got[i][f"dup{size}_chars"] == sum(len(w[j]) for j in inside), (i, size)
        lines = [x for x in t.split("\n") if words(x)]
        assert got[i].dup_line_chars == sum(len(x) for k, x in enumerate(lines) if x in lines[:k])
        chars = sum(map(len, w))
        bad = got[i].dup_line_chars > 0.3 * chars or any(got[i][f"dup{n}_chars"] > most * chars for n, most in quality.MAX_NGRAM_SHARE.items())
        assert got[i].kept == (not got[i].base_failed and not bad)


def test_blocks_of_a_large_group(spark):
    """One n-gram in all texts, which are alike in groups: the links are the same in blocks of two."""
    r = random.Random(25)
    rows = []
    for i in range(30):
        base = [f"b{r.randrange(60)}" for _ in range(12)]
        for k in range(3):
            rows.append((3 * i + k, "all share this start here " + " ".join(base[: 12 - (k == 2)])))
    docs = table_of(spark, rows)
    found = [sorted(map(tuple, ngram_join.jaccard_links(docs, 2, (40, 100), True, block)[1].groupBy().count().collect())) for block in (2, 1000)]
    assert found[0] == found[1] == [(30,)]
