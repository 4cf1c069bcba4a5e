"""Queries on the network, graph measures, portfolios and clusters."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import network as nw
from ..operators import stats as st
from ..operators import windows as wn
from ..sources import scans as sc
from .book import Book
from .surrogates import MADE, TEXTS

book = Book()
add = book.add

#: Holdings of the portfolio queries.
HELD = ["Brand#2", "Brand#9", "Brand#17", "Brand#21"]
_held = "(" + ", ".join(f"'{h}'" for h in HELD) + ")"


def held(t):
    return t("ticker_metadata").where(f"ticker in {_held}").select("ticker")


meta = lambda t: t("ticker_metadata").select("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))
_meta = "(SELECT ticker, coalesce(sector, 'Unknown') AS sector FROM {ticker_metadata})"
E_ = "ticker_i ticker_j signal_strength:d"

add("latest_snapshot", "as_of_date " + E_, lambda t: nw.latest_snapshot(t("edges")), "SELECT * FROM {edges} WHERE as_of_date = (SELECT max(as_of_date) FROM {edges})")
add("network_query", E_, lambda t: nw.network_query(t("net"), 40.0, "ASIA", None, None, "inter", 50), "SELECT * FROM {net} WHERE signal_strength >= 40 AND (sector_i = 'ASIA' OR sector_j = 'ASIA') AND sector_i <> sector_j ORDER BY signal_strength DESC, ticker_i, ticker_j LIMIT 50")
add("network_query_ticker", E_ + " best_lag", lambda t: nw.network_query(t("net"), None, None, 2, "Brand#7"), "SELECT * FROM {net} WHERE best_lag = 2 AND (ticker_i = 'Brand#7' OR ticker_j = 'Brand#7')")
add("pair_detail", "asked_a asked_b found as_of_date signal_strength:d", lambda t: nw.pair_detail(t("edges"), "Brand#9", "Brand#2").unionByName(nw.pair_detail(t("edges"), "Brand#9", "None")),
    "SELECT 'Brand#9' AS asked_a, 'Brand#2' AS asked_b, true AS found, as_of_date, signal_strength FROM {net} WHERE ticker_i = 'Brand#2' AND ticker_j = 'Brand#9' UNION ALL SELECT 'Brand#9', 'None', false, NULL, NULL")
add("ticker_search", "place ticker company_name", lambda t: nw.ticker_search(t("ticker_metadata"), t("general_market_data"), "nation_1", 20), "SELECT 0 AS place, ticker, NULL AS company_name FROM (SELECT DISTINCT ticker FROM {general_market_data} WHERE upper(ticker) LIKE 'NATION\\_1%' ESCAPE '\\') AS x ORDER BY ticker LIMIT 20")
add("ohlcv_range", "source ticker date close:d", lambda t: sc.ohlcv_range([t("market_data"), t("general_market_data").unionByName(t("market_data").where("volume % 2 = 0").withColumn("close", F.col("close") + 1))], "2001-06-30", 90),
    "SELECT * FROM (SELECT 0 AS source, * FROM {market_data} UNION ALL SELECT 1, * FROM {general_market_data}) AS u WHERE date BETWEEN DATE '2001-06-30' - 90 AND DATE '2001-06-30'")
add("node_centrality", "ticker centrality:d", lambda t: nw.node_centrality(t("net")), "SELECT * FROM {centrals}")
add("top_nodes_edges", E_, lambda t: nw.top_nodes_edges(t("net"), 8), "SELECT * FROM {net} WHERE ticker_i IN (SELECT ticker FROM {centrals} ORDER BY centrality DESC, ticker LIMIT 8) AND ticker_j IN (SELECT ticker FROM {centrals} ORDER BY centrality DESC, ticker LIMIT 8)")
add("holding_edges", E_, lambda t: nw.holding_edges(t("net"), held(t)), f"SELECT * FROM {{net}} WHERE ticker_i IN {_held} OR ticker_j IN {_held}")
add("overlap_pairs", E_, lambda t: nw.overlap_pairs(t("net"), held(t)), f"SELECT * FROM {{net}} WHERE ticker_i IN {_held} AND ticker_j IN {_held}")
add("unconnected", "ticker", lambda t: nw.unconnected(t("net"), t("ticker_metadata"), held(t), 60.0), f"SELECT ticker FROM {{ticker_metadata}} WHERE ticker NOT IN {_held} AND ticker NOT IN (SELECT ticker FROM {{ends}} WHERE signal_strength >= 60 AND other IN {_held})")
add("normalize_holdings", "ticker known", lambda t: nw.normalize_holdings(t("customer").select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  brand#"), F.col("c_nationkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.lit("  ")).otherwise(F.lit("xyz ")).alias("symbol")), t("ticker_metadata")),
    "SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_nationkey BETWEEN 1 AND 25 THEN concat('Brand#', c_nationkey) ELSE concat('BRAND#', c_nationkey) END ELSE 'XYZ' END AS ticker, c_custkey % 3 = 0 AND c_nationkey BETWEEN 1 AND 25 AS known FROM {customer} WHERE c_custkey % 3 <> 1")
add("leader_enrich", "ticker price:d change_pct:d company_name", lambda t: t("centrals").select("ticker").join(wn.day_over_day(t("market_data").where("ticker != 'Brand#4'")), "ticker", "left").join(t("ticker_metadata").where("market_cap % 2 = 0").select("ticker", "company_name"), "ticker", "left").withColumn("company_name", F.coalesce("company_name", "ticker")),
    "SELECT c.ticker, price, (price - before) * 100 / before AS change_pct, coalesce(company_name, c.ticker) AS company_name FROM {centrals} AS c LEFT JOIN (SELECT ticker, max(CASE WHEN k = 1 THEN close END) AS price, coalesce(max(CASE WHEN k = 2 THEN close END), max(CASE WHEN k = 1 THEN close END)) AS before FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM {market_data} WHERE ticker <> 'Brand#4') AS x GROUP BY ticker) AS d ON d.ticker = c.ticker LEFT JOIN (SELECT ticker, company_name FROM {ticker_metadata} WHERE market_cap % 2 = 0) AS m ON m.ticker = c.ticker")
add("detail_52w", "ticker company_name high_52w:d low_52w:d", lambda t: t("ticker_metadata").join(t("market_daily").where("date > date '2000-06-30'").groupBy("ticker").agg(F.max("close").alias("high_52w"), F.min("close").alias("low_52w")), "ticker"), "SELECT m.ticker, company_name, high_52w, low_52w FROM {ticker_metadata} AS m JOIN (SELECT ticker, max(close) AS high_52w, min(close) AS low_52w FROM {market_daily} WHERE date > DATE '2000-06-30' GROUP BY ticker) AS x ON x.ticker = m.ticker")
_cand = f"SELECT ticker, count(DISTINCT other) AS links, avg(mean_dcor) AS avg_dcor, min(mean_dcor) AS min_dcor FROM {{ends}} WHERE mean_dcor <= 0.12 AND other IN {_held} AND ticker NOT IN {_held} GROUP BY ticker HAVING count(DISTINCT other) >= 2"
add("candidate_pool", "ticker links avg_dcor:d min_dcor:d", lambda t: nw.candidate_pool(t("net"), held(t), 0.12), _cand)
add("candidate_features", "ticker other leads centrality:d", lambda t: nw.both_ends(t("net")).join(nw.candidate_pool(t("net"), held(t), 0.12).select("ticker"), "ticker"), f"SELECT e.* FROM {{ends}} AS e JOIN ({_cand}) AS c ON c.ticker = e.ticker")
FEATURES = ["signal_strength", "mean_dcor", "variance_dcor", "frequency", "half_life", "sharpness", "best_lag", "centrality", "oos_sharpe_net", "oos_dcor", "half_life_r2"]
SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
#: Links of each stock with all features; those of another origin are missing for some pairs.
TEXTS["links"] = """
SELECT e.*, oos_dcor, half_life_r2 FROM (SELECT ticker_i AS ticker, ticker_j AS other, sector_i AS sector, centrality_i AS centrality, signal_strength, mean_dcor, variance_dcor, frequency, half_life, sharpness, best_lag, oos_sharpe_net, ticker_i, ticker_j FROM {net}
 UNION ALL SELECT ticker_j, ticker_i, sector_j, centrality_j, signal_strength, mean_dcor, variance_dcor, frequency, half_life, sharpness, best_lag, oos_sharpe_net, ticker_i, ticker_j FROM {net}) AS e
LEFT JOIN {oos_dcors} AS o ON o.ticker_i = e.ticker_i AND o.ticker_j = e.ticker_j AND n_windows > 14 LEFT JOIN {stable} AS s ON s.ticker_i = e.ticker_i AND s.ticker_j = e.ticker_j"""
TEXTS["stock_medians"] = "SELECT ticker, min(sector) AS sector, " + ", ".join(f"quantile_cont({c}::DOUBLE, 0.5) AS {c}" for c in FEATURES) + " FROM {links} GROUP BY ticker"
TEXTS["features"] = "SELECT ticker, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {{stock_medians}}), 0) AS {c}" for c in FEATURES) + ", " + ", ".join(f"""CASE WHEN sector = '{x}' THEN 1e0 ELSE 0e0 END AS "sector_{x}\"""" for x in SECTORS) + " FROM {stock_medians}"


def links(t):
    pair = ["ticker_i", "ticker_j"]
    net = t("net").join(t("oos_dcors").where("n_windows > 14").select(*pair, "oos_dcor"), pair, "left").join(t("stable").select(*pair, "half_life_r2"), pair, "left")
    return nw.both_ends(net)


MADE["features"] = lambda t: nw.feature_matrix(links(t), FEATURES, SECTORS)
add("feature_matrix", "ticker " + " ".join(f"{c}:d" for c in FEATURES) + " asia:d", lambda t: t("features").withColumnRenamed("sector_ASIA", "asia"), 'SELECT *, "sector_ASIA" AS asia FROM {features}')

graph = lambda t: nw.build_edges(t("net"), 40.0)
TEXTS["graph"] = "SELECT ticker_i AS src, ticker_j AS dst, signal_strength / 100 AS weight, best_lag FROM {net} WHERE signal_strength >= 40"
add("build_edges", "src dst weight:d best_lag", graph, "SELECT * FROM {graph}")
TEXTS["nodes"] = "SELECT src AS node FROM {graph} UNION SELECT dst FROM {graph}"
add("degree_centrality", "node in_degree:d out_degree:d", lambda t: nw.degree_centrality(graph(t)), "SELECT node, (SELECT count(*) FROM {graph} WHERE dst = node) / ((SELECT count(*) FROM {nodes}) - 1) AS in_degree, (SELECT count(*) FROM {graph} WHERE src = node) / ((SELECT count(*) FROM {nodes}) - 1) AS out_degree FROM {nodes}")
add("net_leadership", "node leadership:d", lambda t: nw.net_leadership(graph(t)), "SELECT node, (o - i) / (o + i) AS leadership FROM (SELECT node, (SELECT count(*) FROM {graph} WHERE src = node) AS o, (SELECT count(*) FROM {graph} WHERE dst = node) AS i FROM {nodes}) AS x")
TEXTS["graph2"] = "SELECT src AS a, dst AS b, weight AS w FROM {graph} UNION ALL SELECT dst, src, weight FROM {graph}"
TEXTS["eig0"] = "SELECT node, 1.0::DOUBLE AS x FROM {nodes}"
#: Rounds in SQL, enough for six digits; Spark goes on until nothing changes.
ROUNDS = 40
for _k in range(1, ROUNDS + 1):
    TEXTS[f"eig{_k}"] = f"SELECT node, y / sqrt(sum(y * y) OVER ()) AS x FROM (SELECT e.node, e.x + coalesce(s, 0) AS y FROM {{eig{_k - 1}}} AS e LEFT JOIN (SELECT a, sum(w * x) AS s FROM {{graph2}} JOIN {{eig{_k - 1}}} AS p ON p.node = b GROUP BY a) AS n ON n.a = e.node) AS y"
add("eigen_centrality", "node centrality:d", lambda t: nw.eigen_centrality(graph(t)), f"SELECT node, x AS centrality FROM {{eig{ROUNDS}}}")
TEXTS["pr0"] = "SELECT node, 1.0::DOUBLE / count(*) OVER () AS r, count(*) OVER () AS n, node NOT IN (SELECT src FROM {graph}) AS d FROM {nodes}"
TEXTS["pr_links"] = "SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM {graph}"
for _k in range(1, ROUNDS + 1):
    TEXTS[f"pr{_k}"] = f"SELECT q.node, 0.15 / n + 0.85 * (coalesce(s, 0) + sum(CASE WHEN d THEN r ELSE 0 END) OVER () / n) AS r, n, d FROM {{pr{_k - 1}}} AS q LEFT JOIN (SELECT dst, sum(z.r * p) AS s FROM {{pr_links}} JOIN {{pr{_k - 1}}} AS z ON z.node = src GROUP BY dst) AS i ON i.dst = q.node"
add("pagerank", "node rank:d", lambda t: nw.pagerank(graph(t)), f"SELECT node, r AS rank FROM {{pr{ROUNDS}}}")
add("network_payload", "kind a b value:d", lambda t: nw.network_payload(graph(t), t("centrals")), "SELECT 'node' AS kind, ticker AS a, coalesce(sector, 'Unknown') AS b, round(centrality, 4) AS value FROM {centrals} UNION ALL SELECT 'edge', src, dst, weight FROM {graph}")

_sig = f"""SELECT ticker, round(0.40 * coalesce(signal, 0) + 0.15 * least(life, 252) / 252 * 100 + 0.15 * links / max(links) OVER () * 100 + 0.20 * (1 - coalesce(h, 0) / 4.0) * 100 + 0.10 * centrality * 100 + 1e-9, 4) AS score, CASE WHEN al THEN 'leads' WHEN an THEN 'both' ELSE 'follows' END AS direction, links, related FROM (
 SELECT ticker, sum(signal_strength * frequency) / nullif(sum(frequency), 0) AS signal, count(DISTINCT other) AS links, max(half_life) AS life, max(centrality) AS centrality, min(sector) AS sector, bool_or(leads) AS an, bool_and(leads) AS al, string_agg(DISTINCT other, ',' ORDER BY other) AS related FROM {{ends}} WHERE signal_strength >= 55 AND other IN {_held} AND ticker NOT IN {_held} GROUP BY ticker) AS x LEFT JOIN (SELECT sector AS hs, count(*) AS h FROM {{ticker_metadata}} WHERE ticker IN {_held} GROUP BY sector) AS y ON hs = x.sector"""
add("signal_recs", "ticker score:d direction links related", lambda t: nw.signal_recs(t("net"), t("ticker_metadata"), held(t)), f"SELECT * FROM ({_sig}) AS s ORDER BY score DESC, ticker LIMIT 10")
add("independent_recs", "ticker score:d", lambda t: nw.independent_recs(t("net"), meta(t), held(t), 60.0), f"SELECT m.ticker, 0.7 * CASE WHEN m.sector IN (SELECT sector FROM {_meta} AS q WHERE ticker IN {_held}) THEN 0 ELSE 1 END + 0.3 * coalesce(centrality, 0) AS score FROM {_meta} AS m LEFT JOIN {{centrals}} AS c ON c.ticker = m.ticker WHERE m.ticker NOT IN {_held} AND m.ticker NOT IN (SELECT ticker FROM {{ends}} WHERE signal_strength >= 60 AND other IN {_held}) ORDER BY score DESC, ticker LIMIT 10")
add("holdings_sectors", "sector n share:d", lambda t: held(t).join(meta(t), "ticker").groupBy("sector").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / 4.0), f"SELECT sector, count(*) AS n, count(*) / 4.0 AS share FROM {_meta} AS m WHERE ticker IN {_held} GROUP BY sector")
add("sector_breakdown", "sector n weight:d share:d", lambda t: nw.sector_breakdown(t("ticker_metadata").select("sector", F.col("market_cap").cast("double").alias("weight"))), "SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS n, sum(market_cap) AS weight, sum(market_cap) / sum(sum(market_cap)) OVER () AS share FROM {ticker_metadata} GROUP BY 1")
TEXTS["momenta"] = """
SELECT l.ticker, round(latest / nullif(past_close, 0) - 1 + 1e-12, 9) AS ret FROM (SELECT ticker, arg_max(close, date) AS latest FROM {market_daily} GROUP BY ticker) AS l LEFT JOIN (
 SELECT ticker, close AS past_close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(date - (SELECT max(date) - 182 FROM {market_daily})), date) AS k FROM {market_daily} WHERE abs(date - (SELECT max(date) - 182 FROM {market_daily})) <= 7) AS x WHERE k = 1) AS p ON p.ticker = l.ticker"""


def ranked_sql(table: str, value: str) -> str:
    """(ticker, score): the average-rank percentile of a value."""
    return f"SELECT ticker, round((rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2) / count(*) OVER () * 100 + 1e-9, 2) AS score FROM {{{table}}} WHERE {value} IS NOT NULL"


TEXTS["momentum_scores"], TEXTS["centrality_scores"] = ranked_sql("momenta", "ret"), ranked_sql("centrals", "centrality")
TEXTS["fundamentals"] = "SELECT ticker, round(0.5 * coalesce(s, CASE WHEN p.sector IS NULL THEN mid_all ELSE coalesce(mid, 50) END) + 0.5 * cap + 1e-9, 2) AS fundamental FROM {pe_scores} AS p LEFT JOIN (SELECT sector, quantile_cont(s, 0.5) AS mid FROM {pe_scores} WHERE sector IS NOT NULL GROUP BY sector) AS m ON m.sector = p.sector, (SELECT quantile_cont(s, 0.5) AS mid_all FROM {pe_scores}) AS a"
TEXTS["factor_scores"] = f"""
SELECT m.ticker, m.sector, a.score AS momentum, fundamental, c.score AS centrality, vol FROM {_meta} AS m LEFT JOIN {{momentum_scores}} AS a ON a.ticker = m.ticker LEFT JOIN {{fundamentals}} AS f ON f.ticker = m.ticker
LEFT JOIN {{centrality_scores}} AS c ON c.ticker = m.ticker LEFT JOIN {{annual_vols}} AS v ON v.ticker = m.ticker"""
MADE["factor_scores"] = lambda t: nw.quality_scores(meta(t), nw.momentum(t("market_daily")).select("ticker", "momentum"), wn.fundamental_score(t("ticker_metadata")).select("ticker", "fundamental"), nw.centrality_score(t("net")), st.annualized_vol(t("market_daily")))
add("momentum", "ticker momentum_return:d momentum:d", lambda t: nw.momentum(t("market_daily")), "SELECT m.ticker, ret AS momentum_return, score AS momentum FROM {momenta} AS m LEFT JOIN {momentum_scores} AS s ON s.ticker = m.ticker")
add("quality_scores", "ticker sector momentum:d fundamental:d centrality:d vol:d", lambda t: t("factor_scores"), "SELECT * FROM {factor_scores}")
add("outer_assembly", "ticker momentum:d fundamental:d centrality:d", lambda t: nw.quality_scores(meta(t), nw.momentum(t("market_daily")).select("ticker", "momentum").where("momentum > 30"), wn.fundamental_score(t("ticker_metadata")).select("ticker", "fundamental").where("fundamental > 30"), nw.centrality_score(t("net")), st.annualized_vol(t("market_daily"))),
    "SELECT ticker, CASE WHEN momentum > 30 THEN momentum END AS momentum, CASE WHEN fundamental > 30 THEN fundamental END AS fundamental, centrality FROM {factor_scores}")


def fitted_scores(t):
    """Scores with the fit of each volatility to the holdings' average."""
    own = t("factor_scores").join(held(t), "ticker", "left_semi").agg(F.avg("vol").alias("vol"))
    return wn.vol_fit(t("factor_scores"), "vol", own)


TEXTS["fitted_scores"] = f"""
SELECT *, CASE WHEN vol IS NULL THEN 50 ELSE (1 - (row_number() OVER (PARTITION BY vol IS NULL ORDER BY abs(vol - own), ticker) - 1) / greatest(count(*) OVER (PARTITION BY vol IS NULL) - 1, 1)) * 100 END AS vol_fit
FROM {{factor_scores}}, (SELECT avg(vol) AS own FROM {{factor_scores}} WHERE ticker IN {_held}) AS h"""
TEXTS["factor_parts"] = f"""
SELECT ticker, 0.35 * coalesce(momentum, 50) AS m, 0.25 * coalesce(fundamental, 50) AS f, 0.20 * CASE WHEN sector IN (SELECT sector FROM {_meta} AS q WHERE ticker IN {_held}) THEN 0 ELSE 100 END AS d, 0.10 * coalesce(vol_fit, 50) AS v, 0.10 * coalesce(centrality, 0) AS c
FROM {{fitted_scores}} WHERE ticker NOT IN {_held}"""
TEXTS["quality"] = """
SELECT ticker, round(m + f + d + v + c + 1e-9, 4) AS score, best[1].k || ' and ' || best[2].k AS why FROM (SELECT *, list_sort([{'v': -round(m, 6), 'k': 'momentum'}, {'v': -round(f, 6), 'k': 'fundamental'}, {'v': -round(d, 6), 'k': 'diversity'}, {'v': -round(v, 6), 'k': 'volatility'}, {'v': -round(c, 6), 'k': 'centrality'}]) AS best FROM {factor_parts}) AS b
ORDER BY score DESC, ticker LIMIT 10"""
held_sectors = lambda t: held(t).join(meta(t), "ticker").select("sector").distinct()
add("quality_picks", "ticker score:d why", lambda t: nw.quality_picks(fitted_scores(t), held_sectors(t), held(t)), "SELECT * FROM {quality}")
_indep = f"SELECT m.ticker, 0.7 * CASE WHEN m.sector IN (SELECT sector FROM {_meta} AS q WHERE ticker IN {_held}) THEN 0 ELSE 1 END + 0.3 * coalesce(centrality, 0) AS score FROM {_meta} AS m LEFT JOIN {{centrals}} AS c ON c.ticker = m.ticker WHERE m.ticker NOT IN {_held} AND m.ticker NOT IN (SELECT ticker FROM {{ends}} WHERE signal_strength >= 60 AND other IN {_held}) ORDER BY score DESC, ticker LIMIT 10"


def portfolio_analysis(t):
    """All parts of a portfolio answer, as rows."""
    named = lambda part, df, ticker="ticker", score="score": df.select(F.lit(part).alias("part"), F.col(ticker).alias("ticker"), F.col(score).alias("score"))
    overlap = nw.overlap_pairs(t("net"), held(t)).withColumn("pair", F.concat_ws("/", "ticker_i", "ticker_j"))
    parts = [named("linked", nw.signal_recs(t("net"), t("ticker_metadata"), held(t))), named("independent", nw.independent_recs(t("net"), meta(t), held(t), 60.0)), named("quality", nw.quality_picks(fitted_scores(t), held_sectors(t), held(t))), named("overlap", overlap, "pair", "signal_strength")]
    return reduce(DataFrame.unionByName, parts)


add("portfolio_analysis", "part ticker score:d", portfolio_analysis, f"""
SELECT 'linked' AS part, ticker, score FROM (SELECT * FROM ({_sig}) AS s ORDER BY score DESC, ticker LIMIT 10) AS a UNION ALL SELECT 'independent', ticker, score FROM ({_indep}) AS b
UNION ALL SELECT 'quality', ticker, score FROM {{quality}} UNION ALL SELECT 'overlap', concat(ticker_i, '/', ticker_j), signal_strength FROM {{net}} WHERE ticker_i IN {_held} AND ticker_j IN {_held}""")

TEXTS["vec_dist"] = "SELECT a, b, d / max(d) OVER () AS dist FROM (SELECT p.vec_id AS a, q.vec_id AS b, sqrt(list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda z: ((z[1] - z[2])::DOUBLE) ** 2))) AS d FROM {embeddings} AS p JOIN {embeddings} AS q ON p.vec_id <> q.vec_id) AS x"
#: All embeddings with the given labelling, block by block; clusters are of candidates.
add("silhouette", "silhouette:d min_size balance_cv:d k", lambda t: cl.silhouette(t("embeddings"), "embedding", "vec_id", "label"),
    "SELECT silhouette, min_size, balance_cv, k FROM (SELECT avg(CASE WHEN own IS NULL THEN 0 ELSE (oth - own) / greatest(own, oth) END) AS silhouette FROM (SELECT a, max(CASE WHEN la = lb THEN d END) AS own, min(CASE WHEN la <> lb THEN d END) AS oth FROM (SELECT a, p.label AS la, q.label AS lb, avg(dist) AS d FROM {vec_dist} JOIN {embeddings} AS p ON p.vec_id = a JOIN {embeddings} AS q ON q.vec_id = b GROUP BY 1, 2, 3) AS m GROUP BY a) AS s) AS t, (SELECT min(n) AS min_size, stddev_pop(n) / avg(n) AS balance_cv, count(*) AS k FROM (SELECT count(*) AS n FROM {embeddings} GROUP BY label) AS c) AS u")


# Clusters of all candidates: scaled features, distances, every k, the chosen one, its picks.

SCALED = [c for c in FEATURES if c != "best_lag"]
KS, RUNS, STEPS = [3, 4, 5, 6], 4, 3


def points(features):
    scaled = st.robust_scale(features, SCALED)
    return scaled.select("ticker", F.array(*[F.round(c, 9) for c in SCALED], *[F.col(f"sector_{x}") for x in SECTORS]).alias("v"))


TEXTS["scaled"] = "SELECT ticker, [" + ", ".join(f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM {{features}})) / (SELECT CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM {{features}}), 9)" for c in SCALED) + ", " + ", ".join(f'"sector_{x}"' for x in SECTORS) + "] AS v FROM {features}"
TEXTS["dist"] = "SELECT a, b, d / max(d) OVER () AS dist FROM (SELECT p.ticker AS a, q.ticker AS b, sqrt(list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) ** 2))) AS d FROM {scaled} AS p JOIN {scaled} AS q ON p.ticker <> q.ticker) AS x"
add("pairwise_distance", "a b dist:d", lambda t: nw.pairwise_distance(points(t("features")), "v", "ticker"), "SELECT * FROM {dist}")
MADE["dist"] = lambda t: nw.pairwise_distance(points(t("features")), "v", "ticker")
MADE["clusters"] = lambda t: nw.kmedoids(t("dist"), KS, RUNS, STEPS)
MADE["sweep"] = lambda t: nw.cluster_sweep(t("dist"), t("clusters"))
TEXTS["dist0"] = "SELECT a, b, dist FROM {dist} UNION ALL SELECT DISTINCT a, a, 0e0 FROM {dist}"
TEXTS["tries"] = f"SELECT k, run, a AS p FROM (SELECT unnest({KS}) AS k) AS ks, (SELECT unnest(range({RUNS})) AS run) AS rs, (SELECT a FROM {{dist0}} WHERE a = b) AS ps"


def _u(step: int, point: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('/', '0', k, run, '{step}', {point})), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


TEXTS["seeds1"] = f"SELECT k, run, p AS m FROM (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY {_u(1, 'p')}, p) AS r FROM {{tries}}) AS x WHERE r = 1"
for _j in range(2, max(KS) + 1):
    TEXTS[f"seeds{_j}"] = f"""SELECT k, run, m FROM {{seeds{_j - 1}}} UNION ALL SELECT k, run, p FROM (SELECT k, run, p, row_number() OVER (PARTITION BY k, run ORDER BY round(-ln({_u(_j, 'p')}) / (d * d), 9), p) AS r FROM (
 SELECT k, run, a AS p, min(dist) AS d FROM {{dist0}} JOIN {{seeds{_j - 1}}} ON b = m WHERE k >= {_j} GROUP BY k, run, a) AS n WHERE d > 0) AS x WHERE r = 1"""
TEXTS["medoids0"] = f"SELECT * FROM {{seeds{max(KS)}}}"
for _j in range(STEPS + 1):
    TEXTS[f"near{_j}"] = f"SELECT k, run, point, m AS medoid, dist FROM (SELECT k, run, a AS point, m, dist, row_number() OVER (PARTITION BY k, run, a ORDER BY round(dist, 9), m) AS r FROM {{dist0}} JOIN {{medoids{_j}}} ON b = m) AS x WHERE r = 1"
    TEXTS[f"medoids{_j + 1}"] = f"""SELECT k, run, a AS m FROM (SELECT k, run, a, row_number() OVER (PARTITION BY k, run, medoid ORDER BY round(s, 9), a) AS r FROM (
 SELECT x.k, x.run, x.medoid, d.a, sum(d.dist) AS s FROM {{near{_j}}} AS x JOIN {{near{_j}}} AS y ON x.k = y.k AND x.run = y.run AND x.medoid = y.medoid JOIN {{dist0}} AS d ON d.a = x.point AND d.b = y.point GROUP BY x.k, x.run, x.medoid, d.a) AS q) AS z WHERE r = 1"""
TEXTS["clusters"] = f"""SELECT n.k, point, medoid, inertia FROM {{near{STEPS}}} AS n JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(inertia, 9), run) AS r FROM (SELECT k, run, sum(dist) AS inertia FROM {{near{STEPS}}} GROUP BY k, run) AS i) AS b ON b.k = n.k AND b.run = n.run AND r = 1"""
TEXTS["sweep"] = """
SELECT z.k, inertia, min_size, max_size, balance_cv, min_size >= 2 AS valid, max_size > points * 0.5 AS oversized, CASE WHEN min_size >= 2 THEN silhouette END AS silhouette FROM (
 SELECT k, max(inertia) AS inertia, min(n) AS min_size, max(n) AS max_size, stddev_pop(n) / avg(n) AS balance_cv, sum(n) AS points FROM (SELECT k, medoid, count(*) AS n, max(inertia) AS inertia FROM {clusters} GROUP BY k, medoid) AS s GROUP BY k) AS z
JOIN (SELECT k, avg(CASE WHEN own IS NULL THEN 0 ELSE (oth - own) / greatest(own, oth) END) AS silhouette FROM (SELECT k, a, max(CASE WHEN la = lb THEN d END) AS own, min(CASE WHEN la <> lb THEN d END) AS oth FROM (
 SELECT p.k, a, p.medoid AS la, q.medoid AS lb, avg(dist) AS d FROM {dist} JOIN {clusters} AS p ON p.point = a JOIN {clusters} AS q ON q.point = b AND q.k = p.k GROUP BY ALL) AS m GROUP BY k, a) AS s GROUP BY k) AS t ON t.k = z.k"""
TEXTS["elbow"] = """
SELECT CASE WHEN count(*) < 3 THEN min(k) ELSE greatest(arg_max(k, CASE WHEN acc IS NOT NULL THEN (acc, -k) END), min(CASE WHEN bef > 0 AND dr / bef < 0.45 THEN k END)) END AS k FROM (
 SELECT *, round(bef - dr, 9) AS acc FROM (SELECT *, lag(dr) OVER (ORDER BY k) AS bef FROM (SELECT k, greatest(inertia - lead(inertia) OVER (ORDER BY k), CASE WHEN lead(inertia) OVER (ORDER BY k) IS NOT NULL THEN 0 END) AS dr FROM {sweep} WHERE valid) AS a) AS b) AS c"""
#: Texts of the clustering from the links on, which can be had of other links too.
CLUSTERING = ["links", "stock_medians", "features", "scaled", "dist", "dist0", "tries", *[f"seeds{j}" for j in range(1, max(KS) + 1)], *[f"{n}{j}" for j in range(STEPS + 1) for n in ("medoids", "near")], "clusters", "sweep", "elbow", "picks", "chosen"]
add("kmedoids", "k point medoid inertia:d", lambda t: t("clusters"), "SELECT * FROM {clusters}")
add("cluster_sweep", "k inertia:d min_size max_size balance_cv:d valid oversized silhouette:d", lambda t: t("sweep"), "SELECT * FROM {sweep}")
add("elbow_k", "k", lambda t: nw.elbow_k(t("sweep")), "SELECT * FROM {elbow}")


def picks_of(t, column="vol"):
    """Of each cluster's sectors the member with the lowest average dCor to its links: (k, sector, ticker, avg_dcor)."""
    low = links(t).groupBy("ticker", "sector").agg(F.avg("mean_dcor").alias("avg_dcor"))
    rows = t("clusters").withColumnRenamed("point", "ticker").join(low, "ticker").where("sector is not null")
    return rows.groupBy("k", "sector").agg(F.min_by(F.struct("ticker", "avg_dcor"), F.struct(F.round("avg_dcor", 9), "ticker")).alias("p")).select("k", "sector", "p.*")


TEXTS["picks"] = """
SELECT k, sector, ticker, avg_dcor FROM (SELECT c.k, sector, ticker, avg_dcor, row_number() OVER (PARTITION BY c.k, sector ORDER BY round(avg_dcor, 9), ticker) AS r FROM {clusters} AS c
 JOIN (SELECT ticker, sector, avg(mean_dcor) AS avg_dcor FROM {links} GROUP BY ticker, sector) AS l ON l.ticker = c.point WHERE sector IS NOT NULL) AS x WHERE r = 1"""
TEXTS["chosen"] = """
SELECT k FROM (SELECT s.k, row_number() OVER (ORDER BY s.k >= (SELECT k FROM {elbow}) DESC, n DESC, round(silhouette, 9) DESC, s.k) AS r FROM {sweep} AS s JOIN (SELECT k, count(DISTINCT sector) AS n FROM {picks} GROUP BY k) AS p ON p.k = s.k WHERE valid) AS x WHERE r = 1"""
add("chosen_k", "k", lambda t: nw.chosen_k(t("sweep"), nw.elbow_k(t("sweep")), picks_of(t)), "SELECT * FROM {chosen}")
add("cluster_picks", "k sector ticker avg_dcor:d", picks_of, "SELECT * FROM {picks}")
add("cluster_quality", "n_sectors n_over ok", lambda t: nw.cluster_quality(picks_of(t).join(nw.chosen_k(t("sweep"), nw.elbow_k(t("sweep")), picks_of(t)), "k"), 0.25, 5),
    "SELECT count(DISTINCT sector) AS n_sectors, count(*) FILTER (avg_dcor > 0.25) AS n_over, count(DISTINCT sector) = count(*) AND count(DISTINCT sector) >= 5 AND count(*) FILTER (avg_dcor > 0.25) = 0 AS ok FROM {picks} WHERE k = (SELECT k FROM {chosen})")
add("compare_picks", "sector ticker_a ticker_b delta:d", lambda t: nw.compare_picks(*[picks_of(t).where(F.col("k") == k).withColumnRenamed("avg_dcor", "dcor") for k in (KS[0], KS[-1])]),
    f"SELECT coalesce(a.sector, b.sector) AS sector, a.ticker AS ticker_a, b.ticker AS ticker_b, b.avg_dcor - a.avg_dcor AS delta FROM (SELECT * FROM {{picks}} WHERE k = {KS[0]}) AS a FULL JOIN (SELECT * FROM {{picks}} WHERE k = {KS[-1]}) AS b ON a.sector = b.sector")
