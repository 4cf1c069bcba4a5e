"""Properties with fixed seeds: bounds, planted effects, known answers, maintenance round trips."""

import hashlib
import itertools
import os
import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagweave import catalog
from lagweave.operators import network as nw
from lagweave.operators import pairs as pr
from lagweave.operators import ranks
from lagweave.operators import risk as rk
from lagweave.operators import stats as st
from lagweave.operators import windows as wn
from lagweave.plans import surrogates
from lagweave.sources import scans as sc
from lagweave.streaming import jobs


def matrix_dcor(x, y):
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    v = (a * a).mean() * (b * b).mean()
    return np.sqrt(max((a * b).mean(), 0) / np.sqrt(v)) if v > 0 else 0.0


def test_distance_correlation():
    r = np.random.default_rng(1)
    x, y = r.normal(size=300), r.normal(size=300)
    for u, v in ((x, y), (x, x), (x, x**2), (np.round(x), y)):
        assert abs(pr.distance_correlation(u, v) - matrix_dcor(u, v)) < 1e-9
    assert pr.distance_correlation(x, x) == pytest.approx(1) and pr.distance_correlation(x, np.ones(300)) == 0.0
    assert pr.distance_correlation(x, x**2) > 0.3 > pr.distance_correlation(x, y) and pr.distance_correlation(x[:3], y[:3]) == 0.0


def series(spark, planted_lag=2, n=120):
    r = np.random.default_rng(3)
    a, noise, other = r.normal(size=n), r.normal(size=n) * 0.2, r.normal(size=n)
    b = np.concatenate([np.zeros(planted_lag), a[:-planted_lag]]) + noise
    rows = [(t, i, float(v[i])) for t, v in (("a", a), ("b", b), ("c", other)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, d int, log_return double")
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "d"))


def pairs_of(s):
    return pr.paired(pr.series_arrays(s), pr.all_pairs(s.select("ticker").distinct()))


def test_planted_pair_is_found(spark):
    rows = pairs_of(series(spark))
    best = {(x.ticker_i, x.ticker_j): x for x in pr.best_lag(pr.dcor_lag(rows, (1, 2, 3)), ["ticker_i", "ticker_j"]).collect()}
    assert best["a", "b"].best_lag == 2 and best["a", "b"].dcor > 0.8
    got = {(x.ticker_i, x.ticker_j, x.lag): x for x in pr.permutation_p(rows, (2,), tiers=((20, 0.3), (40, None))).collect()}
    assert got["a", "b", 2].p_value == pytest.approx(1 / 41) and got["a", "b", 2].permutations == 40
    assert all(0 < x.p_value <= 1 for x in got.values())
    assert pr.all_pairs(series(spark).select("ticker").distinct(), "both").count() == 6


def plain_orders(name, n, perm, block=5):
    """Blocks in the order of SplitMix64-like hashes, in whole numbers of Python."""
    mask, seed = 2**64 - 1, int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "little")

    def key(b):
        x = seed ^ ((((perm << 32) + b) * 0x9E3779B97F4A7C15) & mask)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & mask
        return x ^ (x >> 31)

    order = sorted(range(-(-n // block)), key=lambda b: (key(b), b))
    return [i for b in order for i in range(b * block, min(n, (b + 1) * block))]


def test_permutations_against_a_plain_loop(spark):
    s = series(spark, n=48).withColumn("window_start", F.lit(7))
    rows = pr.paired(pr.series_arrays(s, keys=["window_start"]), pr.all_pairs(s.select("ticker").distinct()))
    tiers = ((10, 0.30), (30, None))
    got = {(x.ticker_i, x.ticker_j, x.lag): x for x in pr.permutation_p(rows, (1, 2), tiers=tiers, floor=0.2, seed=3).collect()}
    v = {t: np.array([r.log_return for r in s.where(F.col("ticker") == t).orderBy("d").collect()]) for t in "abc"}
    for i, j in (("a", "b"), ("a", "c"), ("b", "c")):
        for lag in (1, 2):
            x, y = v[i][:-lag], v[j][lag:]
            observed, name = matrix_dcor(x, y), f"3/{j}/7/{i}/{lag}"
            r = got[i, j, lag]
            assert r.dcor == pytest.approx(observed, abs=1e-9)
            names = {f"3/{'/'.join(map(str, n))}" for n in itertools.permutations((7, i, j))}
            want = set()
            for base in names:  # the keys' order is the join's
                p, done, hits = 1.0, 0, 0
                if observed >= 0.2:
                    for count, stop in tiers:
                        hits += sum(matrix_dcor(x[plain_orders(f"{base}/{lag}", len(x), k)], y) >= observed - 1e-9 for k in range(done, count))
                        p, done = (hits + 1) / (count + 1), count
                        if stop is not None and p > stop:
                            break
                want.add((round(p, 9), done))
            assert (round(r.p_value, 9), r.permutations) in want, (name, want)


def test_permutation_queries_take_all_pairs_and_tiers(spark, monkeypatch):
    s = series(spark, n=60).withColumn("window_start", F.lit("2020-01-01").cast("date")).withColumn("win", F.lit(1)).persist()
    monkeypatch.setattr(surrogates, "get", lambda spark, sf_dir, name: s)
    got = {(r.ticker_i, r.ticker_j, r.lag): r for r in catalog.QUERIES["permutation_p"](spark, "").collect()}
    assert set(got) == {(i, j, k) for i, j in (("a", "b"), ("a", "c"), ("b", "c")) for k in (1, 2, 3)}
    assert got["a", "b", 2].permutations == 1000 and got["a", "b", 2].p_value == pytest.approx(1 / 1001, abs=1e-6)
    assert {r.permutations for r in got.values()} <= {0, 100, 500, 1000}
    last = [r.permutations == 1000 for r in got.values()]
    assert catalog.QUERIES["tier_budget"](spark, "").first().tier3_fraction == pytest.approx(sum(last) / 9, abs=1e-6)
    assert {(r.ticker_i, r.ticker_j, r.lag): r.p_value for r in catalog.QUERIES["pair_panel"](spark, "").collect()} == {k: r.p_value for k, r in got.items()}


def test_block_orders_are_permutations():
    got = pr.block_orders("x", 23, 0, 5)
    assert all(sorted(x) == list(range(23)) for x in got.tolist()) and len({tuple(x) for x in got.tolist()}) == 5
    assert pr.block_orders("x", 23, 3, 2).tolist() == got[3:].tolist() and got.tolist() == [plain_orders("x", 23, k) for k in range(5)]


def test_ranks_of_a_whole_table(spark):
    r = np.random.default_rng(5)
    v = [None if x < 0.1 else float(round(x, 1)) for x in r.random(200)]
    df = spark.createDataFrame(list(enumerate(v)), "ticker long, x double")
    got = {a.ticker: a.p for a in ranks.average_rank_pct(df, "x", "p").collect()}
    want = pd.Series(v, dtype=float).rank(pct=True)
    assert all((got[i] is None and x is None) or got[i] == pytest.approx(want[i]) for i, x in enumerate(v))
    assert [a.place for a in ranks.numbered(df, [F.col("x").desc_nulls_last(), F.col("ticker")]).orderBy(F.col("x").desc_nulls_last(), "ticker").collect()] == list(range(1, 201))


def test_bh_is_monotone(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    df = spark.createDataFrame([(1, "a", f"b{i}", 1, v) for i, v in enumerate(p)], "window_start int, ticker_i string, ticker_j string, lag int, p_value double")
    q = [r.q_value for r in pr.bh_fdr(df).orderBy("p_value").collect()]
    assert q == sorted(q) and q[0] == pytest.approx(0.008) and all(a >= b for a, b in zip(q, p))


def test_half_life(spark):
    rows = [("a", "b", t, 0.5 * float(np.exp(-0.1 * t))) for t in range(20)] + [("a", "c", t, 0.3) for t in range(10)] + [("a", "d", 0, 0.3)]
    got = {r.ticker_j: r for r in st.half_life(spark.createDataFrame(rows, "ticker_i string, ticker_j string, win int, dcor double")).collect()}
    assert got["b"].half_life == 252 and got["b"].half_life_stable and got["b"].half_life_r2 > 0.99
    assert got["d"].half_life == -1.0 and not got["d"].half_life_stable


def test_ols_with_a_singular_group(spark):
    r = np.random.default_rng(2)
    rows = [("g", float(x), float(z), float(1 + 2 * x - z)) for x, z in r.normal(size=(50, 2))] + [("h", 1.0, 1.0, 3.0)] * 50
    b = {x.k: x.beta for x in st.ols(spark.createDataFrame(rows, "k string, a double, b double, y double"), ["k"], "y", ["a", "b"], 10).collect()}
    assert b["g"] == pytest.approx([1, 2, -1]) and sum(b["h"]) == pytest.approx(3)


def test_sharpe_of_a_constant_is_null(spark):
    assert spark.range(50).select(F.lit(0.01).alias("r")).agg(st.sharpe("r").alias("s")).first().s is None


def test_signal_strength_flat_and_ordered(spark):
    flat = spark.createDataFrame([(1.0,)] * 5, "s double")
    assert {r.signal_strength for r in st.signal_strength(flat, "s").collect()} == {50.0}
    got = [r.signal_strength for r in st.signal_strength(spark.createDataFrame([(float(i),) for i in range(40)], "s double"), "s").orderBy("s").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 100


def test_recovery_and_drawdown(spark):
    v = [1.0, 1.2, 0.6, 0.9, 1.3]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "ticker string, step int, price double")
    assert wn.max_drawdown(df, "price", ["ticker"], "step").first().max_drawdown == pytest.approx(-0.5)
    assert wn.time_to_recovery(df, "price", ["ticker"], "step").first().recovery == 2


def test_var_is_not_above_mean(spark):
    r = np.random.default_rng(4).normal(size=500)
    t = rk.tail_measures(spark.createDataFrame([(float(x),) for x in r], "r double"), []).first()
    assert t.cvar <= t["var"] <= t["mean"] and abs(t["var"] - np.quantile(r, 0.05)) < 1e-9


def test_write_and_replace(spark):
    path = f"/tmp/spark-table-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "w int, v int")
    sc.write_table(rows, path, "errorifexists", partition=["w"], cluster=["v"])
    sc.write_table(rows.where("false"), path, "overwrite")
    sc.upsert_snapshot(spark.createDataFrame([(2, 99)], "w int, v int"), path, "w")
    assert sorted((r.w, r.v) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 99)]
    sc.replace_window(spark.createDataFrame([(1, 5), (2, 6)], "w int, v int"), path, 1, "w")
    sc.replace_window(rows.where("false"), path, 2, "w")
    assert [(r.w, r.v) for r in spark.read.parquet(path).collect()] == [(1, 5)]


def test_text_ingest(spark):
    lines = spark.createDataFrame([("Annual block",), ("19630701,  -0.67,  0.02, -0.35, 0.012",), (" 20200102, 1, 2, 3, 4, 5, 0.5 ",), ("1963, 1, 2, 3, 4",)], "value string")
    got = sorted(sc.factor_text(lines).collect(), key=lambda r: r.date)
    assert len(got) == 2 and got[0].mkt_rf == pytest.approx(-0.0067) and got[0].rmw is None and got[1].rf == pytest.approx(0.005) and got[1].cma == pytest.approx(0.05)


def test_holdings_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Fund Holdings as of,"Jan 1"\n\nTicker,Name,Sector,Asset Class,Weight (%)\n"AAPL","Apple, Inc.","Tech","Equity","7.5"\nBRK.B,"Berkshire ""B""",Fin,Equity,"1,000.5"\nUSD,Cash,-,Cash,1\n-,X,Y,Equity,2\nAAPL,Again,Tech,Equity,1\n')
    (tmp_path / "b.csv").write_text("Name,Ticker\nMicrosoft,msft\n")
    (tmp_path / "c.csv").write_text("no header here\nMSFT,x\n")
    got = {(r.file.rsplit("/", 1)[1], r.ticker): r.weight_pct for r in sc.holdings_text(sc.read_holdings(spark, str(tmp_path))).collect()}
    assert got == {("a.csv", "AAPL"): 7.5, ("a.csv", "BRK-B"): 1000.5, ("b.csv", "MSFT"): 1.0}


def test_late_clicks_are_dropped(spark, tmp_path):
    day = lambda d, u: f'{{"ts": "2024-01-{d:02d}T01:00:00Z", "user_id": {u}, "event_type": "click"}}\n'
    # a batch drops rows by the watermark that the batch before began with
    for i, text in enumerate([day(1, 1) + day(1, 1), day(9, 1), day(9, 1), day(1, 1) + day(9, 1)]):
        (tmp_path / f"{i}.json").write_text(text)
        os.utime(tmp_path / f"{i}.json", (1000 + i, 1000 + i))
    source = spark.readStream.schema("ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    folder = jobs.scratch(spark, "late")
    got = {(str(r.window_start)[:10], r.n) for r in jobs.stream_clicks(spark, source, f"{folder}/out", f"{folder}/state").collect()}
    assert got == {("2024-01-01", 2), ("2024-01-09", 3)}


def test_streamed_prices_over_batches(spark, tmp_path):
    """Each batch continues from the marks of the one before; a first return is against the stored close."""
    rows = [("a", d, 10.0 + d) for d in range(1, 7)] + [("b", d, 5.0 * d) for d in range(3, 7)]
    df = spark.createDataFrame(rows, "ticker string, d int, close double").select("ticker", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("date"), "close")
    for i, (lo, hi) in enumerate(((1, 4), (3, 5), (5, 6))):
        df.where(F.col("date").between(F.date_add(F.lit("2024-01-01").cast("date"), lo), F.date_add(F.lit("2024-01-01").cast("date"), hi))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.stream_prices(spark, source, df.where("ticker = 'a' and day(date) <= 3"), f"{jobs.scratch(spark, 'p')}/t", f"{jobs.scratch(spark, 'c')}/s")
    want = {(r.ticker, r.date, r.log_return and round(r.log_return, 9)) for r in sc.log_return(df).collect()}
    assert {(r.ticker, r.date, r.log_return and round(r.log_return, 9)) for r in got.collect()} == want


def test_medoids_of_planted_clusters(spark):
    r = np.random.default_rng(6)
    at = {f"p{g}{i}": np.array([10.0 * g, 0.0]) + r.normal(size=2) * 0.1 for g in range(3) for i in range(6)}
    top = max(np.linalg.norm(x - y) for x in at.values() for y in at.values())
    dist = spark.createDataFrame([(a, b, float(np.linalg.norm(x - y) / top)) for a, x in at.items() for b, y in at.items() if a != b], "a string, b string, dist double")
    clusters = nw.kmedoids(dist, [2, 3, 4], runs=4, rounds=4)
    sweep = nw.cluster_sweep(dist, clusters, min_size=1).persist()
    three = {x.point: x.medoid for x in clusters.where("k = 3").collect()}
    assert all((three[a] == three[b]) == (a[:2] == b[:2]) for a in at for b in at)
    inertia = sum(np.linalg.norm(at[p] - at[m]) / top for p, m in three.items())
    assert clusters.where("k = 3").first().inertia == pytest.approx(inertia)
    assert nw.elbow_k(sweep).first().k == 3 and sweep.where("k = 3").first().silhouette > 0.9


def test_regression_measures(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(60, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + r.normal(size=60) * 0.5
    df = spark.createDataFrame([(float(a), float(b), float(c), 5.0) for (a, b), c in zip(x, y)], "a double, b double, y double, half_life double")
    got = {z.feature: z for z in st.score_regression(df, "y", ["a", "b"]).collect()}
    full = np.column_stack([np.ones(60), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    left, total = ((y - full @ beta) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    assert [got[f].weight for f in ("intercept", "a", "b")] == pytest.approx(list(beta))
    assert got["a"].r2 == pytest.approx(1 - left / total) and got["a"].f == pytest.approx((total - left) / 2 / (left / 57))
    assert st.score_regression(df.withColumn("half_life", F.lit(-1.0)), "y", ["a", "b"]).count() == 0
