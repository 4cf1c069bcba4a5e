"""The network that the analysis itself ends in, and what is served from it: stability over windows,
out-of-sample Sharpe ratios and distance correlations, signal strength and centralities."""

from pyspark.sql import functions as F

from ..operators import network as nw
from ..operators import pairs as pr
from ..operators import stats as st
from ..staging import staged
from .book import Book
from .network import _held, _sig, held
from .pairs import LAGS, PAIR, pairs_of
from .surrogates import MADE, TEXTS

book = Book()
add = book.add
TIDY = ["mean_dcor", "variance_dcor", "frequency", "sharpness", "oos_sharpe_net", "oos_dcor"]

#: A pair trades with the sign of its correlation at its best lag over the whole history.
TEXTS["directions"] = "SELECT s.ticker_i, s.ticker_j, s.best_lag, corr(l.x, l.y) AS oos_sharpe_net FROM {stable} AS s JOIN {lagged} AS l ON l.ticker_i = s.ticker_i AND l.ticker_j = s.ticker_j AND l.lag = s.best_lag GROUP BY 1, 2, 3"
TEXTS["final_strategy"] = TEXTS["strategy"].replace("{net}", "{directions}")
TEXTS["final_sharpes"] = TEXTS["sharpes"].replace("{strategy}", "{final_strategy}")
TEXTS["final_scored"] = """
SELECT (SELECT max(window_end) FROM {windows}) AS as_of_date, s.ticker_i, s.ticker_j, s.best_lag, round(mean_dcor + 1e-9, 6) AS mean_dcor, round(variance_dcor + 1e-9, 6) AS variance_dcor, round(frequency + 1e-9, 6) AS frequency,
 round(sharpness + 1e-9, 6) AS sharpness, round(sharpe_net + 1e-9, 6) AS oos_sharpe_net, round(oos_dcor + 1e-9, 6) AS oos_dcor, half_life
FROM {stable} AS s LEFT JOIN {final_sharpes} AS g ON g.ticker_i = s.ticker_i AND g.ticker_j = s.ticker_j LEFT JOIN {oos_dcors} AS o ON o.ticker_i = s.ticker_i AND o.ticker_j = s.ticker_j"""
TEXTS["final_net"] = """
SELECT e.*, i.sector AS sector_i, j.sector AS sector_j, round(avg(signal_strength) OVER (PARTITION BY ticker_i) / 100 + 1e-9, 6) AS centrality_i, round(avg(signal_strength) OVER (PARTITION BY ticker_j) / 100 + 1e-9, 6) AS centrality_j
FROM (SELECT s.*, round(CASE WHEN hi > lo THEN (least(greatest(mean_dcor, lo), hi) - lo) / (hi - lo) * 100 ELSE 50 END + 1e-9, 6) AS signal_strength
 FROM {final_scored} AS s, (SELECT quantile_cont(mean_dcor, 0.05) AS lo, quantile_cont(mean_dcor, 0.95) AS hi FROM {final_scored}) AS q) AS e
LEFT JOIN {ticker_metadata} AS i ON i.ticker = ticker_i LEFT JOIN {ticker_metadata} AS j ON j.ticker = ticker_j"""
TEXTS["final_ends"] = TEXTS["ends"].replace("{net}", "{final_net}")
TEXTS["final_centrals"] = TEXTS["centrals"].replace("{ends}", "{final_ends}")


def directed(t):
    """(ticker_i, ticker_j, lag, direction) of the stable pairs."""
    profile = pr.pearson_lag(pairs_of(t), LAGS).select(*PAIR, F.col("lag").alias("best_lag"), F.col("pearson").alias("direction"))
    return t("stable").select(*PAIR, "best_lag").join(profile, [*PAIR, "best_lag"]).withColumnRenamed("best_lag", "lag")


def final_net(t):
    """Every stable pair with its scores, signal strength, sectors and the centralities of its ends."""
    sharpe = st.strategy_sharpes(t("returns"), t("returns"), directed(t), 26).select(*PAIR, F.col("sharpe_net").alias("oos_sharpe_net"))
    last = t("windows").agg(F.max("window_end").alias("as_of_date"))
    scored = t("stable").join(sharpe, PAIR, "left").join(t("oos_dcors").select(*PAIR, "oos_dcor"), PAIR, "left").join(F.broadcast(last))  # one row
    scored = scored.select("as_of_date", *PAIR, "best_lag", "half_life", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in TIDY])
    out = st.signal_strength(staged(scored, "scored"), "mean_dcor").withColumn("signal_strength", F.round(F.col("signal_strength") + 1e-9, 6))
    for x in "ij":
        sector = t("ticker_metadata").select(F.col("ticker").alias(f"ticker_{x}"), F.col("sector").alias(f"sector_{x}"))
        central = out.groupBy(f"ticker_{x}").agg(F.round(F.avg("signal_strength") / 100 + 1e-9, 6).alias(f"centrality_{x}"))
        out = out.join(sector, f"ticker_{x}", "left").join(central, f"ticker_{x}")
    return out


MADE["final_net"] = final_net
_E = "ticker_i ticker_j best_lag sector_i sector_j signal_strength:d"
net = lambda t: t("final_net")

add("final_network", "as_of_date " + _E + " mean_dcor:d variance_dcor:d frequency:d sharpness:d half_life:d oos_sharpe_net:d oos_dcor:d centrality_i:d centrality_j:d", net, "SELECT * FROM {final_net}")
add("final_top_pairs", _E, lambda t: net(t).where("signal_strength >= 50").orderBy(F.desc("signal_strength"), "ticker_i", "ticker_j").limit(20), "SELECT * FROM {final_net} WHERE signal_strength >= 50 ORDER BY signal_strength DESC, ticker_i, ticker_j LIMIT 20")
add("final_network_query", _E, lambda t: nw.network_query(net(t), 40.0, "ASIA", None, None, "inter", 50), "SELECT * FROM {final_net} WHERE signal_strength >= 40 AND (sector_i = 'ASIA' OR sector_j = 'ASIA') AND sector_i <> sector_j ORDER BY signal_strength DESC, ticker_i, ticker_j LIMIT 50")
add("final_centrality", "ticker centrality:d", lambda t: nw.node_centrality(net(t)), "SELECT * FROM {final_centrals}")
add("final_holding_edges", _E, lambda t: nw.holding_edges(net(t), held(t)), f"SELECT * FROM {{final_net}} WHERE ticker_i IN {_held} OR ticker_j IN {_held}")
add("final_signal_recs", "ticker score:d direction links related", lambda t: nw.signal_recs(net(t), t("ticker_metadata"), held(t)), f"SELECT * FROM ({_sig.replace('{ends}', '{final_ends}')}) AS s ORDER BY score DESC, ticker LIMIT 10")
add("final_edges", "src dst weight:d best_lag", lambda t: nw.build_edges(net(t), 40.0), "SELECT ticker_i AS src, ticker_j AS dst, signal_strength / 100 AS weight, best_lag FROM {final_net} WHERE signal_strength >= 40")
