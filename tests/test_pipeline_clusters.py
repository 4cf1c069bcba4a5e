"""The risk pipeline's picks follow from the clusters of the candidates."""

from functools import cache
from statistics import fmean

import pytest

from lagweave import catalog  # noqa: F401  registers all tables, in the order in which their SQL needs them
from lagweave.operators import network
from lagweave.plans import risk
from lagweave.plans.network import HELD
from lagweave.plans.surrogates import MADE

SECTORS = ["AFRICA", "AMERICA", "ASIA"]
#: The first of each sector by name is the farthest from the others, the fourth is in their middle.
OFFSETS = [0.9, 0.0, 0.1, 0.2, 0.3]


@pytest.fixture(scope="module")
def tables(spark):
    """Three sectors far apart, their candidates linked alike to all holdings: no average dCor tells them apart."""
    stocks = {f"{s}-{i}": (s, 10.0 * j + x) for j, s in enumerate(SECTORS) for i, x in enumerate(OFFSETS)}
    edges = [(h, c, v, 0.5, v, v, v, v, 1, v, v, v, "EUROPE", s) for h in HELD for c, (s, v) in stocks.items()]
    sims = [(n, step, c, 1 + 0.01 * step * ((7 * n + 3 * j) % 5 - 2)) for n in range(1, 11) for step in range(1, 4) for j, c in enumerate([*HELD, *stocks])]
    given = {
        "net": spark.createDataFrame(edges, "ticker_i string, ticker_j string, signal_strength double, mean_dcor double, variance_dcor double, frequency double, half_life double, sharpness double, best_lag int, centrality_i double, centrality_j double, oos_sharpe_net double, sector_i string, sector_j string"),
        "oos_dcors": spark.createDataFrame([], "ticker_i string, ticker_j string, oos_dcor double, n_windows long"),
        "stable": spark.createDataFrame([], "ticker_i string, ticker_j string, half_life_r2 double"),
        "ticker_metadata": spark.createDataFrame([*((h, "EUROPE") for h in HELD), *((c, s) for c, (s, _) in stocks.items())], "ticker string, sector string"),
        "scenarios": spark.createDataFrame(sims, "sim_id long, step int, ticker string, price double"),
        "returns": spark.createDataFrame([(c, d, 0.01 * ((d + j) % 4 - 2)) for d in range(1, 9) for j, c in enumerate([*HELD, *stocks])], "ticker string, date int, log_return double"),
    }

    @cache
    def table(name):
        return given[name] if name in given else MADE[name](table).cache()

    return table


def test_clusters_decide_between_candidates_of_the_same_dcor(tables):
    rows = {r.sector: r for r in risk.risk_pipeline(tables).collect() if r.place is not None}
    assert {s: r.ticker for s, r in rows.items()} == {s: f"{s}-3" for s in SECTORS}
    assert all(r.cluster.startswith(s) and r.cluster_size == len(OFFSETS) for s, r in rows.items())


def test_picks_of_every_number_of_clusters_equal_plain_loops(tables):
    dist = {(r.a, r.b): r.dist for r in tables("pool_dist").collect()}
    clusters, mine = tables("pool_clusters").collect(), risk.pool_picks(tables).collect()
    assert {r.point for r in clusters} == {f"{s}-{i}" for s in SECTORS for i in range(len(OFFSETS))}  # no holding among them
    best = {}
    for p in clusters:
        members = [q.point for q in clusters if (q.k, q.medoid) == (p.k, p.medoid)]
        inner = fmean(dist.get((p.point, q), 0.0) for q in members)
        key = (p.k, p.point.split("-")[0])
        best[key] = min(best.get(key, (9.0,)), (round(inner, 9), p.point, p.medoid, len(members)))
    assert {(r.k, r.sector): (round(r.mean_intra_dist, 9), r.ticker, r.cluster, r.cluster_size) for r in mine} == best


def test_a_stock_alone_in_its_cluster_has_no_distance(spark):
    dist = spark.createDataFrame([(a, b, abs(x - y)) for a, x in zip("pqr", (0.0, 0.4, 1.0)) for b, y in zip("pqr", (0.0, 0.4, 1.0)) if a != b], "a string, b string, dist double")
    clusters = spark.createDataFrame([(2, "p", "p"), (2, "q", "p"), (2, "r", "r")], "k int, point string, medoid string")
    assert {(r.point, r.cluster_size, r.mean_intra_dist) for r in network.intra_distances(dist, clusters).collect()} == {("p", 2, 0.2), ("q", 2, 0.2), ("r", 1, 0.0)}
