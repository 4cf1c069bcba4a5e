"""Operators that avoid a task for everything: selection by rank, FDR by ranges, merging, iteration to
convergence; and the chain from permutations to stable pairs."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagweave import catalog
from lagweave.operators import clusters
from lagweave.operators import network as nw
from lagweave.operators import pairs as pr
from lagweave.operators import stats as st
from lagweave.operators import windows as wn
from lagweave.operators.quantiles import exact_quantiles
from lagweave.plans import surrogates

PROBS = (0, 0.05, 0.1, 0.25, 0.5, 0.7, 0.95, 1)


@pytest.mark.parametrize("buckets, few", [(1024, 4096), (4, 5), (2, 1)])
def test_quantiles_equal_percentiles(spark, buckets, few):
    r = np.random.default_rng(1)
    inf, nan = float("inf"), float("nan")
    columns = {
        "normal": r.normal(size=700), "ties": r.integers(0, 4, 700).astype(float), "flat": np.full(700, 3.5),
        "tails": np.exp(r.normal(size=700) * 9), "signs": np.where(r.random(700) < 0.5, -0.0, 1e308 * r.choice([-1.0, 1.0], 700)),
        "odd": np.where(r.random(700) < 0.2, r.choice([inf, -inf, nan], 700), r.random(700)),
    }
    rows = [tuple(None if r.random() < 0.1 else float(x) for x in row) + (None,) for row in zip(*columns.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "none"])).repartition(5)
    got = exact_quantiles(df, {c: F.col(c) for c in df.columns}, PROBS, buckets, few)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, map(float, PROBS)))).alias(c) for c in df.columns]).first()
    for c in columns:
        if c != "odd":
            assert list(map(repr, [x + 0.0 for x in got[c]])) == list(map(repr, [x + 0.0 for x in want[c]])), c
    assert got["none"] == [None] * len(PROBS)
    v = np.sort([x for x in (row[5] for row in rows) if x is not None])  # NaN last
    at = (len(v) - 1) * np.array(PROBS)
    assert [repr(float(x)) for x, k in zip(got["odd"], at) if k == int(k)] == [repr(float(v[int(k)])) for k in at if k == int(k)]


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "ticker string, x double")
    assert exact_quantiles(empty, {"x": F.col("x")}, (0.5,)) == {"x": [None]}
    assert st.signal_strength(empty, "x").count() == st.robust_scale(empty, ["x"]).count() == st.deciles(empty.withColumn("y", F.col("x")), "x", "y").count() == 0


def plain_bh(df, alpha):
    w = W.partitionBy("window_start").orderBy("p_value", "ticker_i", "ticker_j", "lag")
    raw = df.withColumn("raw", F.col("p_value") * F.count(F.lit(1)).over(W.partitionBy("window_start")) / F.row_number().over(w))
    return raw.withColumn("q_value", F.least(F.lit(1.0), F.min("raw").over(w.rowsBetween(0, W.unboundedFollowing)))).withColumn("significant", F.col("q_value") <= alpha).drop("raw")


def test_fdr_by_ranges_equals_one_window(spark):
    r = np.random.default_rng(2)
    sizes = {1: 900, 2: 40, 3: 1, None: 25}
    rows = [(w, f"a{k}", f"b{k % 7}", int(k % 3), float(np.round(r.random() ** 3, 2))) for w, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "window_start int, ticker_i string, ticker_j string, lag int, p_value double")
    got, want = (sorted(map(repr, x.select(sorted(x.columns)).collect())) for x in (pr.bh_fdr(df, 0.1), plain_bh(df, 0.1)))
    assert got == want
    spread = pr.ranged(df, [F.col("window_start"), F.col("p_value")], ["window_start"]).where("window_start = 1").groupBy("__part").count()
    assert spread.count() > 1 and spread.agg(F.max("count")).first()[0] < 900
    assert pr.bh_fdr(df.limit(0)).count() == 0


def planted(spark, tickers=10, days=120, windows=2):
    """Returns of tickers by window; of each window some followers repeat a leader a few days later."""
    r, rows = np.random.default_rng(3), []
    for w in range(windows):
        v = r.normal(size=(tickers, days))
        for k in range(0, tickers - 4, 2):
            v[k + 1, 1 + k % 3 :] = v[k, : days - 1 - k % 3] + 0.15 * r.normal(size=days - 1 - k % 3)
        rows += [(w, f"t{k}", d, float(x)) for k in range(tickers) for d, x in enumerate(v[k])]
    df = spark.createDataFrame(rows, "window_start int, ticker string, d int, log_return double")
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "d")).withColumn("win", F.col("window_start") + 5)


def test_chain_from_permutations_to_stability(spark, monkeypatch):
    s = planted(spark).persist()
    rows = pr.paired(pr.series_arrays(s, keys=["window_start", "win"]), pr.all_pairs(s.select("ticker").distinct()))
    fixed = pr.permutation_p(rows, (1, 2, 3), tiers=((100, 0.20), (500, 0.10), (1000, None)))
    chain = pr.permutation_p(rows, (1, 2, 3), alpha=0.05)
    used = lambda df: df.agg(F.sum("permutations")).first()[0]
    best = pr.bh_fdr(fixed, 0.05, choose="dcor")
    assert used(chain) < used(best) < used(fixed)
    key = lambda x: (x.window_start, x.ticker_i, x.ticker_j)
    full = {key(x): x for x in best.collect()}
    got = {key(x): x for x in pr.bh_fdr(chain, 0.05, choose="dcor").collect()}
    assert got.keys() == full.keys() and len(got) == 90
    assert all((a.lag, a.significant) == (full[k].lag, full[k].significant) and abs(a.dcor - full[k].dcor) < 1e-12 for k, a in got.items())
    assert all(a.q_value == pytest.approx(full[k].q_value) for k, a in got.items() if a.significant)
    found = {k: a for k, a in got.items() if a.significant}
    assert {(w, f"t{k}", f"t{k + 1}") for w in (0, 1) for k in (0, 2, 4)} <= found.keys()
    assert all(found[w, f"t{k}", f"t{k + 1}"].lag == 1 + k % 3 for w in (0, 1) for k in (0, 2, 4))

    # the registered queries run the same chain
    tables = {"window_returns": s, "windows": s.select("window_start", "win").distinct()}
    tables["w_dcor"] = pr.dcor_lag(rows, (1, 2, 3))
    tables["tested"] = surrogates.MADE["tested"](tables.__getitem__)
    monkeypatch.setattr(surrogates, "get", lambda spark, sf_dir, name: tables[name])
    again = {key(x): x for x in catalog.QUERIES["bh_fdr_permuted"](spark, "").collect()}
    assert {k for k, a in again.items() if a.significant} == set(found)
    stable = {(x.ticker_i, x.ticker_j): x for x in catalog.QUERIES["stability_permuted"](spark, "").collect()}
    assert set(stable) == {k[1:] for k in found}
    for pair, x in stable.items():
        mine = [a for k, a in found.items() if k[1:] == pair]
        assert x.n_windows_observed == len(mine) and x.frequency == len(mine) / 2
        assert x.mean_dcor == pytest.approx(np.mean([a.dcor for a in mine]), abs=1e-6)


def test_threshold_is_that_of_the_procedure(spark):
    r = np.random.default_rng(4)
    rows = [(w, float(np.round(r.random() ** (1 + w), 2))) for w in range(5) for _ in range(60)]
    got = {x.w: x.threshold for x in pr.bh_threshold(spark.createDataFrame(rows, "w int, p double"), ["w"], 0.1).collect()}
    for w in range(5):
        p = sorted(x for v, x in rows if v == w)
        passed = [x for k, x in enumerate(p) if x <= 0.1 * (k + 1) / len(p) + 1e-12]
        assert got[w] == (max(passed) if passed else None)


def test_concordant_pairs():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 17, 60):
        for spread in (2, 5, 1000):
            p, t = r.integers(0, spread, n).astype(float), r.integers(0, spread, n).astype(float)
            want = sum(p[i] > p[j] and t[i] > t[j] for i, j in itertools.permutations(range(n), 2))
            assert wn.concordant_pairs(p, t) == want
            assert wn._ordered_pairs(p) == sum(p[i] > p[j] for i, j in itertools.permutations(range(n), 2))
    began = time.time()
    p = r.normal(size=20_000)
    assert wn.concordant_pairs(p, p) == 20_000 * 19_999 // 2 and wn.concordant_pairs(p, -p) == 0
    assert time.time() - began < 5


def test_pair_accuracy_with_ties_and_gaps(spark):
    r = np.random.default_rng(6)
    rows = [(d, f"t{k}", None if r.random() < 0.1 else float(r.integers(0, 6)), None if r.random() < 0.1 else float(r.integers(0, 6))) for d in range(4) for k in range(30)]
    got = wn.ordered_pair_accuracy(spark.createDataFrame(rows, "date int, ticker string, a double, b double"), "a", "b").first()
    both = [(x, y) for x, y in itertools.permutations(rows, 2) if x[0] == y[0] and None not in (x[2], y[2]) and x[2] > y[2]]
    judged = [x[3] > y[3] for x, y in both if None not in (x[3], y[3])]
    assert got.pairs == len(both) and got.accuracy == pytest.approx(np.mean(judged))
    none = wn.ordered_pair_accuracy(spark.createDataFrame([], "date int, ticker string, a double, b double"), "a", "b").first()
    assert (none.accuracy, none.pairs) == (None, 0)


def graph(spark):
    r = np.random.default_rng(7)
    rows = [(f"n{a}", f"n{b}", float(w), 1) for a, b, w in zip(r.integers(0, 12, 40), r.integers(0, 12, 40), r.random(40) + 0.1) if a != b]
    rows += [("x", "n0", 0.9, 1), ("n1", "loose", 0.4, 1)]
    return rows, spark.createDataFrame(rows, "src string, dst string, weight double, best_lag int")


def test_eigenvector_and_pagerank_converge(spark):
    rows, df = graph(spark)
    nodes = sorted({x for r in rows for x in r[:2]})
    at = {x: i for i, x in enumerate(nodes)}
    a, p = np.zeros((2, len(nodes), len(nodes)))
    for s, d, w, _ in rows:
        a[at[s], at[d]] = a[at[d], at[s]] = max(w, a[at[s], at[d]])
        p[at[d], at[s]] += w
    values, vectors = np.linalg.eigh(a + np.eye(len(nodes)))
    want = np.abs(vectors[:, -1])
    got = {r.node: r.centrality for r in nw.eigen_centrality(df, 1e-10).collect()}
    assert [got[x] for x in nodes] == pytest.approx(want.tolist(), abs=1e-9)
    x = np.array([got[n] for n in nodes])
    assert np.abs((a + np.eye(len(nodes))) @ x - values[-1] * x).sum() < 1e-9
    loose = p.sum(axis=0) == 0
    p[:, ~loose] /= p[:, ~loose].sum(axis=0)
    p[:, loose] = 1 / len(nodes)
    rank = np.linalg.solve(np.eye(len(nodes)) - 0.85 * p, np.full(len(nodes), 0.15 / len(nodes)))
    got = {r.node: r.rank for r in nw.pagerank(df, 1e-10).collect()}
    assert [got[x] for x in nodes] == pytest.approx(rank.tolist(), abs=1e-9) and sum(got.values()) == pytest.approx(1)


def test_iteration_on_odd_graphs(spark):
    none = spark.createDataFrame([], "src string, dst string, weight double, best_lag int")
    assert nw.eigen_centrality(none).count() == nw.pagerank(none).count() == 0
    two = spark.createDataFrame([("a", "b", 1.0, 1)], "src string, dst string, weight double, best_lag int")  # bipartite
    assert [r.centrality for r in nw.eigen_centrality(two).collect()] == pytest.approx([0.5**0.5] * 2)


def plain_strategy(x, y, lag, direction, lookback, cost=0.001):
    """(day, signal, position, gross, net) by a loop over the common days."""
    days = sorted(set(x) & set(y))
    if len(days) < lookback + lag + 10:
        return []
    a, b = [x[d] for d in days], [y[d] for d in days]
    z = [None] * len(days)
    for i in range(lookback, len(days)):
        w = a[i - lookback : i]
        sd = np.std(w)
        z[i] = (a[i] - np.mean(w)) / sd if sd > 1e-10 else None
    out = []
    for i in range(lag, len(days)):
        if (s := z[i - lag]) is not None:
            p = (-1 if direction is not None and direction < 0 else 1) * (1 if s > 1 else -1 if s < -1 else 0)
            out.append((days[i], s, p, p * b[i], p * b[i] - cost * abs(p)))
    return out


def test_strategy_against_a_loop(spark):
    r = np.random.default_rng(8)
    v = {t: {d: float(x) for d, x in enumerate(r.normal(size=90)) if r.random() < 0.9} for t in "abcd"}
    v["d"] = {d: 0.25 if d < 60 else x for d, x in v["d"].items()}  # flat, then not
    v["e"] = {d: 1.0 for d in range(12)}
    s = spark.createDataFrame([(t, d, x) for t, of in v.items() for d, x in of.items()], "ticker string, d int, log_return double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "d"))
    asked = [("a", "b", 1, 0.3), ("a", "c", 3, -0.2), ("d", "a", 2, None), ("e", "a", 1, 1.0), ("a", "missing", 1, 1.0), ("b", "c", None, 1.0)]
    pairs = spark.createDataFrame(asked, "ticker_i string, ticker_j string, lag int, direction double")
    got = {}
    for x in st.strategy_returns(s, s, pairs, 20).withColumn("d", F.datediff("date", F.lit("2020-01-01"))).collect():
        got.setdefault((x.ticker_i, x.ticker_j), []).append((x.d, x.signal, x.position, x.gross, x.net))
    want = {(i, j): plain_strategy(v[i], v[j], lag, w, 20) for i, j, lag, w in asked if lag and j in v}
    assert got.keys() == {k for k, x in want.items() if x}
    for k, rows in got.items():
        assert [x[0] for x in sorted(rows)] == [x[0] for x in want[k]] and np.allclose(sorted(rows), want[k])
    sharpe = {(x.ticker_i, x.ticker_j): x for x in st.strategy_sharpes(s, s, pairs, 20).collect()}
    assert sharpe.keys() == {k for k, x in want.items() if len(x) >= 30}
    for k, x in sharpe.items():
        net = [w[4] for w in want[k]]
        assert x.n_days == len(net) and x.sharpe_net == pytest.approx(np.mean(net) / np.std(net) * 252**0.5)
    part = st.strategy_returns(s, s, pairs, 20, start="2020-02-15", end="2020-03-10")
    assert part.agg(F.min("date"), F.max("date")).first()[0].isoformat() >= "2020-02-15" and part.count() == sum(45 <= x[0] <= 69 for rows in want.values() for x in rows)


def test_sampled_medoids(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(4, 3)) * 20
    rows = [(f"p{i:06d}", (centres[i % 4] + r.normal(size=3)).tolist()) for i in range(100_000)]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(8)
    got = clusters.sampled_kmedoids(df, "v", "id", [2, 4], samples=3, sample=100)
    assert got.groupBy("k").count().collect() and got.count() == 200_000
    four = got.where("k = 4").withColumn("true", F.substring("point", 2, 6).cast("int") % 4)
    assert four.groupBy("medoid").agg(F.count_distinct("true").alias("n"), F.count(F.lit(1)).alias("of")).where("n = 1 and of = 25000").count() == 4
    assert four.agg(F.abs(F.sum("dist") - F.max("inertia"))).first()[0] < 1e-3
    best = {x.k: x.inertia for x in got.groupBy("k").agg(F.max("inertia").alias("inertia")).collect()}
    assert best[4] < best[2]


def test_sampled_medoids_of_few_points(spark):
    """No worse than alternation on 25 points; fewer points than clusters; none."""
    r = np.random.default_rng(10)
    df = spark.createDataFrame([(f"p{i}", r.normal(size=5).tolist()) for i in range(25)], "id string, v array<double>")
    d = nw.pairwise_distance(df, "v", "id")
    old = {x.k: x.inertia for x in nw.kmedoids(d, [3, 5], 4, 3).groupBy("k").agg(F.max("inertia").alias("inertia")).collect()}
    v = np.array([x.v for x in df.collect()])
    scale = clusters.distances(v, v).max()
    new = {x.k: x.inertia / scale for x in clusters.sampled_kmedoids(df, "v", "id", [3, 5]).groupBy("k").agg(F.max("inertia").alias("inertia")).collect()}
    assert all(new[k] <= old[k] + 1e-9 for k in old)
    assert clusters.sampled_kmedoids(df.limit(2), "v", "id", [4]).where("dist = 0 and point = medoid").count() == 2
    assert clusters.sampled_kmedoids(df.limit(0), "v", "id", [4]).count() == 0


def test_swaps_find_the_best_medoids():
    r = np.random.default_rng(11)
    hits = 0
    for _ in range(20):
        d = clusters.distances(*[r.normal(size=(12, 2))] * 2)
        best = min(d[:, list(c)].min(axis=1).sum() for c in itertools.combinations(range(12), 3))
        hits += min(d[:, clusters.swapped_medoids(d, 3, np.random.default_rng(s))].min(axis=1).sum() for s in range(4)) <= best + 1e-9
    assert hits >= 18


def test_single_precision_counts_what_double_does(spark):
    r = np.random.default_rng(12)
    for n, scale in ((24, 1.0), (60, 1e-5), (120, 1e6), (251, 0.02)):
        x = r.normal(size=n) * scale
        for y in (r.normal(size=n), x + 0.5 * scale * r.normal(size=n), np.round(r.normal(size=n)), np.tile([1.0, 2.0, 3.0, 4.0, 5.0], n)[:n]):
            d = pr.Distances(x, y)
            observed = min(1.0, max(0.0, float(d.ratios(np.arange(n)[None])[0])))
            orders = pr.block_orders("s", n, 0, 300)
            plain = int((np.clip(d.ratios(orders), 0, 1) >= observed - 1e-12).sum())
            assert abs(pr._hits(x, y, "s", 0, 300) - plain) <= (1 if n == 24 else 0), (n, scale)
            z = pr.Distances(x / scale, y)
            for least in np.quantile(z.ratios(orders), [0.01, 0.5, 0.99]):
                assert z.reach(orders, least - 1e-12) == int((z.ratios(orders) >= least - 1e-12).sum())


def test_rolling_residuals_from_panes(spark):
    """Windows as sums of quarters: the residuals of a regression on each window's own rows."""
    r = np.random.default_rng(13)
    rows = [(t, d, float(a), float(b), float(1 + 2 * a - b + r.normal() * (1 + d / 700))) for t in ("a", "b") for d in range(730) if r.random() < (0.5 if t == "a" else 0.08) for a, b in [r.normal(size=2)]]
    df = spark.createDataFrame(rows, "ticker string, d int, f double, g double, y double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "d"))
    windows = spark.sql("SELECT s AS window_start, date_sub(add_months(s, 12), 1) AS window_end, CAST(n AS INT) AS win FROM (SELECT posexplode(sequence(date'2020-01-01', date'2021-01-01', interval 3 months)) AS (n, s))")
    got = {(x.win, x.ticker, x.date): x.residual for x in st.rolling_residuals(df, windows, "y", ["f", "g"], 40).collect()}
    want = {}
    days = {x.d: x.date for x in df.select("d", "date").distinct().collect()}
    for w in windows.collect():
        for t in ("a", "b"):
            own = [x for x in rows if x[0] == t and w.window_start <= days[x[1]] <= w.window_end]
            if len(own) >= 40:
                x = np.array([[1, q[2], q[3]] for q in own])
                y = np.array([q[4] for q in own])
                left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
                want |= {(w.win, t, days[q[1]]): e for q, e in zip(own, left)}
    assert got.keys() == want.keys() and {k[1] for k in want} == {"a"}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_decay_is_no_worse_than_a_fine_grid():
    r = np.random.default_rng(14)
    t = [np.sort(r.choice(40, n, replace=False)).astype(float) for n in r.integers(1, 25, 60)]
    t = [x - x[0] for x in t]
    y = [np.abs(a * np.exp(-b * x) + c * r.normal(size=len(x))) for x, a, b, c in zip(t, r.random(60), 10.0 ** r.uniform(-4, 1, 60), r.choice([0, 0.01, 0.3], 60))]
    of = np.repeat(np.arange(60), [len(x) for x in t])
    rate = st.decay_rates(np.concatenate(t), np.concatenate(y), of, 60)

    def sse(x, v, k):
        e = np.exp(-k * x)
        return ((v - max((v @ e) / (e @ e), 0) * e) ** 2).sum()

    for x, v, k in zip(t, y, rate):
        grid = min(sse(x, v, g) for g in 10.0 ** np.linspace(-6, 1, 41))
        assert sse(x, v, k) <= grid + 1e-11 and 1e-6 <= k <= 10


def test_half_life_of_planted_decay(spark):
    rows = [("a", f"b{k}", w, 0.6 * float(np.exp(-k * 0.1 * w))) for k in range(1, 8) for w in range(12)]
    rows += [("a", "flat", w, 0.4) for w in range(6)] + [("a", "two", w, 0.4) for w in range(2)] + [("a", "up", w, 0.1 * (w + 1)) for w in range(6)]
    got = {x.ticker_j: x for x in st.half_life(spark.createDataFrame(rows, "ticker_i string, ticker_j string, win int, dcor double")).collect()}
    for k in range(1, 8):
        assert got[f"b{k}"].half_life == pytest.approx(min(np.log(2) / (k * 0.1) * 63, 252), rel=1e-9) and got[f"b{k}"].half_life_r2 == pytest.approx(1)
    assert got["flat"].half_life == got["up"].half_life == 252 and not got["flat"].half_life_stable
    assert (got["two"].half_life, got["two"].half_life_r2, got["two"].half_life_stable) == (-1, 0, False)
