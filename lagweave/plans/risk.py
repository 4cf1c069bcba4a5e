"""Queries on scenarios and risk: all tickers, draws over the whole history."""

import re

from pyspark.sql import functions as F

from ..operators import network as nw
from ..operators import risk as rk
from ..operators import stats as st
from ..operators import windows as wn
from ..staging import staged
from .book import Book
from .network import CLUSTERING, FEATURES, HELD, KS, RUNS, SECTORS, _held, held, links, points
from .network import STEPS as ROUNDS
from .surrogates import MADE, TEXTS

book = Book()
add = book.add
SIMS, STEPS, BLOCK, SEED = 200, 52, 21, 7


# Scenarios by joint block bootstrap of the stored returns.

TEXTS["dates"] = "SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS pos FROM (SELECT DISTINCT date FROM {returns} WHERE log_return IS NOT NULL) AS d"
TEXTS["dated"] = """
SELECT t.ticker, d.pos, coalesce(log_return, 0) AS log_return FROM (SELECT DISTINCT ticker FROM {returns}) AS t JOIN {dates} AS d ON true LEFT JOIN {returns} AS r ON r.ticker = t.ticker AND r.date = d.date"""
TEXTS["draws"] = f"""
SELECT sim_id, step, CAST(1 + floor((('0x' || substr(md5(concat_ws('/', '{SEED}', sim_id, CAST(floor((step - 1) / {BLOCK}) AS BIGINT))), 1, 8))::BIGINT / 4294967296.0) * greatest((SELECT count(*) FROM {{dates}}) - {BLOCK}, 1)) + (step - 1) % {BLOCK} AS INT) AS pos
FROM (SELECT unnest(range(1, {SIMS + 1})) AS sim_id) AS s JOIN (SELECT unnest(range(1, {STEPS + 1})) AS step) AS t ON true"""
TEXTS["scenarios"] = "SELECT sim_id, step, ticker, round(exp(sum(log_return) OVER (PARTITION BY sim_id, ticker ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS price FROM {draws} AS d JOIN {dated} AS r ON r.pos = d.pos"


def draws(t):
    positions = t("returns").where("log_return is not null").select("date").distinct()
    return rk.block_draws(t("returns").sparkSession.range(1, SIMS + 1).withColumnRenamed("id", "sim_id"), positions, STEPS, BLOCK, SEED)


# rounded once, to the digits of the result, so that sums in another order make no other troughs and peaks
MADE["scenarios"] = lambda t: rk.scenario_paths(rk.dated_returns(t("returns")), draws(t)).withColumn("price", F.round("price", 6))
add("block_bootstrap", "sim_id step pos", draws, "SELECT * FROM {draws}")
add("scenario_paths", "sim_id step ticker price:d", lambda t: t("scenarios"), "SELECT * FROM {scenarios}")

_q = "quantile_cont(price, [0.05, 0.16, 0.5, 0.84, 0.95])"
TEXTS["cone"] = f"SELECT ticker, step, avg(price) AS mean, avg(CASE WHEN price > 1 THEN 1.0 ELSE 0 END) AS p_up, {_q}[1] AS p5, {_q}[2] AS p16, {_q}[3] AS p50, {_q}[4] AS p84, {_q}[5] AS p95 FROM {{scenarios}} GROUP BY ticker, step"
cone = lambda t: rk.bands(t("scenarios"), ["ticker", "step"], "price")
add("price_bands", "ticker step p5:d p16:d p50:d p84:d p95:d", cone, "SELECT * FROM {cone}")
TEXTS["actual"] = "SELECT ticker, pos - 1 AS step, close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) AS actual FROM {returns}"
actual = lambda t: wn.index_to_100(t("returns")).select("ticker", (F.col("pos") - 1).alias("step"), (F.col("indexed") / 100).alias("actual"))
add("return_cone", "ticker step actual:d mean:d p_up:d p5:d p95:d", lambda t: cone(t).join(actual(t), ["ticker", "step"]), "SELECT c.*, actual FROM {cone} AS c JOIN {actual} AS a ON a.ticker = c.ticker AND a.step = c.step")
add("band_coverage", "coverage:d", lambda t: rk.band_coverage(cone(t), actual(t), ["ticker", "step"]),
    "SELECT avg(CASE WHEN actual BETWEEN p16 AND p84 THEN 1.0 ELSE 0 END) AS coverage FROM {cone} AS c JOIN {actual} AS a ON a.ticker = c.ticker AND a.step = c.step")


# Portfolio of all tickers by market value.

TEXTS["wts"] = "SELECT ticker, market_cap / sum(market_cap) OVER () AS weight FROM {ticker_metadata}"
wts = lambda t: rk.resolve_weights(t("scenarios"), t("ticker_metadata").select("ticker", F.col("market_cap").cast("double").alias("weight")))
add("resolve_weights", "ticker weight:d", wts, "SELECT * FROM {wts}")
TEXTS["folio"] = "SELECT sim_id, step, 1 + sum(weight * (price - 1)) AS price FROM {scenarios} AS s JOIN {wts} AS w ON w.ticker = s.ticker GROUP BY sim_id, step"
add("portfolio_paths", "sim_id step price:d", lambda t: rk.portfolio_paths(t("scenarios"), wts(t)), "SELECT * FROM {folio}")


# Measures: the same SQL for groups of keys and for the whole.

def risk_texts(tag: str, paths: str, keys: str, returns: str) -> None:
    """TEXTS ends_, tail_, draw_, back_, down_ and risk_ of a tag; keys is 'ticker' or a constant."""
    skew = "(avg(r ** 3) - 3 * avg(r) * avg(r ** 2) + 2 * avg(r) ** 3) / (avg(r ** 2) - avg(r) ** 2) ** 1.5"
    TEXTS[f"ends_{tag}"] = f"SELECT sim_id, {keys} AS k, arg_max(price, step) - 1 AS r FROM {{{paths}}} GROUP BY ALL"
    TEXTS[f"tail_{tag}"] = f"""
SELECT q.*, cvar, CASE WHEN abs(var) <= 1e-10 THEN 1 ELSE cvar / var END AS tail_ratio FROM (
 SELECT k, quantile_cont(r, 0.05) AS var, avg(CASE WHEN r < 0 THEN 1.0 ELSE 0 END) AS prob_loss, avg(CASE WHEN r >= 0.1 THEN 1.0 ELSE 0 END) AS prob_target, {skew} AS skew, avg(r) AS mean FROM {{ends_{tag}}} GROUP BY k) AS q
JOIN (SELECT e.k, avg(r) AS cvar FROM {{ends_{tag}}} AS e JOIN (SELECT k, quantile_cont(r, 0.05) AS v FROM {{ends_{tag}}} GROUP BY k) AS c ON c.k = e.k AND r <= v + 1e-12 GROUP BY e.k) AS t ON t.k = q.k"""
    TEXTS[f"draw_{tag}"] = f"SELECT k, avg(d) AS mean_drawdown, quantile_cont(d, 0.05) AS worst_p5 FROM (SELECT sim_id, k, min(x) AS d FROM (SELECT sim_id, {keys} AS k, price / max(price) OVER (PARTITION BY sim_id, {keys} ORDER BY step) - 1 AS x FROM {{{paths}}}) AS y GROUP BY sim_id, k) AS z GROUP BY k"
    TEXTS[f"path_{tag}"] = f"SELECT sim_id, {keys} AS k, step, price, arg_min(step, (price, step)) OVER (PARTITION BY sim_id, {keys}) AS low FROM {{{paths}}}"
    TEXTS[f"back_{tag}"] = f"""
SELECT k, CASE WHEN count(recovery) >= 0.1 * count(*) THEN avg(recovery) END AS recovery FROM (SELECT p.sim_id, p.k, min(CASE WHEN step > low AND price >= peak THEN step END) - any_value(low) AS recovery FROM {{path_{tag}}} AS p
 LEFT JOIN (SELECT sim_id, k, max(price) AS peak FROM {{path_{tag}}} WHERE step < low GROUP BY sim_id, k) AS m ON m.sim_id = p.sim_id AND m.k = p.k GROUP BY p.sim_id, p.k) AS x GROUP BY k"""
    TEXTS[f"down_{tag}"] = f"SELECT {keys} AS k, CASE WHEN stddev_samp(CASE WHEN log_return < 0 THEN log_return END) * sqrt(252) > 1e-10 THEN avg(log_return) * 252 / (stddev_samp(CASE WHEN log_return < 0 THEN log_return END) * sqrt(252)) END AS sortino FROM {{{returns}}} GROUP BY 1"
    TEXTS[f"risk_{tag}"] = f"SELECT t.*, mean_drawdown, worst_p5, recovery, sortino FROM {{tail_{tag}}} AS t JOIN {{draw_{tag}}} AS d ON d.k = t.k JOIN {{back_{tag}}} AS b ON b.k = t.k JOIN {{down_{tag}}} AS s ON s.k = t.k"


TEXTS["folio_returns"] = "SELECT date, sum(weight * log_return) AS log_return FROM {returns} AS x JOIN {wts} AS w ON w.ticker = x.ticker GROUP BY date"
folio_returns = lambda t: t("returns").join(wts(t), "ticker").groupBy("date").agg(F.sum(F.col("weight") * F.col("log_return")).alias("log_return"))
risk_texts("t", "scenarios", "ticker", "returns")
risk_texts("p", "folio", "'all'", "folio_returns")
_MEASURES = "var:d cvar:d tail_ratio:d prob_loss:d prob_target:d skew:d mean:d mean_drawdown:d worst_p5:d recovery:d sortino:d"

tails = lambda t: rk.tail_measures(rk.terminal(t("scenarios"), ["ticker"]), ["ticker"])
for _n, _c in (("var", "var"), ("cvar", "cvar"), ("tail_ratio", "tail_ratio"), ("prob_loss", "prob_loss"), ("prob_target", "prob_target"), ("skewness", "skew")):
    add(_n, f"ticker {_c}:d", tails, "SELECT k AS ticker, * FROM {tail_t}")
add("drawdown_summary", "ticker mean_drawdown:d worst_p5:d", lambda t: rk.drawdown_summary(t("scenarios"), ["ticker"]), "SELECT k AS ticker, * FROM {draw_t}")
add("recovery_summary", "ticker recovery:d", lambda t: rk.recovery_summary(t("scenarios"), ["ticker"]), "SELECT k AS ticker, * FROM {back_t}")
add("stock_risk", f"ticker {_MEASURES}", lambda t: rk.risk_table(t("scenarios"), ["ticker"], t("returns")), "SELECT k AS ticker, * FROM {risk_t}")
add("portfolio_risk", _MEASURES, lambda t: rk.risk_table(rk.portfolio_paths(t("scenarios"), wts(t)), [], folio_returns(t)), "SELECT * FROM {risk_p}")
add("diversification_benefit", "benefit:d", lambda t: rk.diversification_benefit(t("scenarios"), wts(t)), "SELECT (SELECT var FROM {tail_p}) - (SELECT sum(weight * var) FROM {tail_t} AS t JOIN {wts} AS w ON w.ticker = t.k) AS benefit")
TEXTS["contributions"] = "SELECT e.k AS ticker, any_value(weight) * avg(r) AS contribution FROM {ends_t} AS e JOIN {wts} AS w ON w.ticker = e.k WHERE sim_id IN (SELECT sim_id FROM {ends_p} WHERE r <= (SELECT quantile_cont(r, 0.05) + 1e-12 FROM {ends_p})) GROUP BY e.k"
add("risk_contribution", "ticker contribution:d share:d", lambda t: rk.risk_contribution(t("scenarios"), wts(t)), "SELECT *, contribution / sum(contribution) OVER () AS share FROM {contributions}")
add("return_histogram", "bin tail n", lambda t: rk.return_histogram(rk.terminal(t("scenarios"), ["ticker"]), -1.0, 1.0, 20, -0.2), "SELECT CASE WHEN r < -1 THEN 0 WHEN r >= 1 THEN 21 ELSE floor((r + 1) * 10) + 1 END::BIGINT AS bin, r <= -0.2 AS tail, count(*) AS n FROM {ends_t} GROUP BY 1, 2")
add("portfolio_sortino", "sortino:d", lambda t: folio_returns(t).agg(st.sortino("log_return").alias("sortino")), "SELECT sortino FROM {down_p}")


# The risk pipeline: risk of the holdings, candidates, their clusters, one pick a sector, their rank.

WEIGHTS = {"var": (0.3, True), "mean_drawdown": (0.2, True), "sortino": (0.2, True), "skew": (0.2, True), "avg_dcor": (0.1, False)}

#: The clustering of plans/network.py, of the candidates alone.
MADE["pool"] = lambda t: nw.candidate_pool(t("net"), held(t), 1.0)
MADE["pool_features"] = lambda t: nw.feature_matrix(links(t).join(t("pool").select("ticker"), "ticker", "left_semi"), FEATURES, SECTORS)
MADE["pool_dist"] = lambda t: nw.pairwise_distance(points(t("pool_features")), "v", "ticker")
MADE["pool_clusters"] = lambda t: nw.kmedoids(t("pool_dist"), KS, RUNS, ROUNDS)
MADE["pool_sweep"] = lambda t: nw.cluster_sweep(t("pool_dist"), t("pool_clusters"))


def pool_picks(t):
    """For every k, of each sector the candidate with the lowest average dCor to the holdings; of several
    with the same that which is nearest to its cluster, by the mean distance to its members."""
    inner = nw.intra_distances(t("pool_dist"), t("pool_clusters")).withColumnsRenamed({"point": "ticker", "medoid": "cluster"})
    grouped = t("pool").select("ticker", "avg_dcor").join(t("ticker_metadata").select("ticker", "sector"), "ticker").join(inner, "ticker")
    return nw.pick_per_sector(grouped, "avg_dcor", "mean_intra_dist", within=("k",))


MADE["pool_picks"] = pool_picks


def risk_pipeline(t):
    """One row for the holdings (place null) and one for each sector's pick, by risk rank, with its
    cluster among the candidates: the cluster's medoid and size at the chosen number of clusters, and the
    pick's mean distance to its members."""
    k = nw.chosen_k(t("pool_sweep"), nw.elbow_k(t("pool_sweep")), t("pool_picks"))
    picks = t("pool_picks").join(F.broadcast(k), "k").select("ticker", "sector", "cluster", "cluster_size", "mean_intra_dist", "avg_dcor")  # one row
    picks = staged(picks, "picks")  # a row a sector, read for every measure
    risk = rk.risk_table(t("scenarios").join(picks.select("ticker"), "ticker", "left_semi"), ["ticker"], t("returns"))
    measured = staged(picks.join(risk, "ticker"), "measured")  # a row a sector, ranked in several passes
    ranked = wn.minmax_rank(measured, WEIGHTS).select("ticker", "sector", "cluster", "cluster_size", (F.col("cluster") == F.col("ticker")).alias("is_medoid"), "mean_intra_dist", "score", "place", "var")
    own = rk.resolve_weights(held(t))
    mine = t("returns").join(own, "ticker").groupBy("date").agg(F.sum(F.col("weight") * F.col("log_return")).alias("log_return"))
    total = rk.risk_table(staged(rk.portfolio_paths(t("scenarios"), own), "paths"), [], mine)
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    whole = total.select(F.lit("holdings").alias("ticker"), none("sector", "string"), none("cluster", "string"), none("cluster_size", "long"), none("is_medoid", "boolean"), none("mean_intra_dist", "double"), none("score", "double"), none("place", "long"), "var")
    return ranked.unionByName(whole)


TEXTS["pool"] = f"SELECT ticker, avg(mean_dcor) AS avg_dcor FROM {{ends}} WHERE mean_dcor <= 1.0 AND other IN {_held} AND ticker NOT IN {_held} GROUP BY ticker HAVING count(DISTINCT other) >= {len(HELD) // 2}"
TEXTS |= {f"pool_{n}": re.sub(r"\{(\w+)\}", lambda m: f"{{pool_{m[1]}}}" if m[1] in CLUSTERING else m[0], TEXTS[n]) for n in CLUSTERING}
TEXTS["pool_links"] = "SELECT * FROM {links} WHERE ticker IN (SELECT ticker FROM {pool})"
TEXTS["pool_inner"] = "SELECT x.k, x.point AS member, x.medoid AS cluster, count(*) AS cluster_size, avg(dist) AS mean_intra_dist FROM {pool_clusters} AS x JOIN {pool_clusters} AS y ON y.k = x.k AND y.medoid = x.medoid JOIN {pool_dist0} AS d ON d.a = x.point AND d.b = y.point GROUP BY x.k, x.point, x.medoid"
TEXTS["pool_picks"] = """
SELECT * FROM (SELECT c.k, sector, p.ticker, cluster, cluster_size, avg_dcor, mean_intra_dist, row_number() OVER (PARTITION BY c.k, sector ORDER BY round(avg_dcor, 9), round(mean_intra_dist, 9), p.ticker) AS r FROM {pool} AS p
 JOIN {ticker_metadata} AS m ON m.ticker = p.ticker JOIN {pool_inner} AS c ON c.member = p.ticker WHERE sector IS NOT NULL) AS x WHERE r = 1"""
TEXTS["sector_picks"] = "SELECT * FROM {pool_picks} WHERE k = (SELECT k FROM {pool_chosen})"
TEXTS["pick_risk"] = "SELECT p.ticker, sector, cluster, cluster_size, mean_intra_dist, avg_dcor, var, mean_drawdown, sortino, skew FROM {sector_picks} AS p JOIN {risk_t} AS r ON r.k = p.ticker"
_scaled = " + ".join(f"{w} * CASE WHEN max({m}) OVER () = min({m}) OVER () THEN 0.5 ELSE " + (f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())" if up else f"1 - ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())") + " END" for m, (w, up) in WEIGHTS.items())
TEXTS["pick_score"] = f"SELECT *, ({_scaled}) / {sum(w for w, _ in WEIGHTS.values())} AS score FROM {{pick_risk}}"
add("risk_pipeline", "ticker sector cluster cluster_size is_medoid mean_intra_dist:d score:d place var:d", risk_pipeline, f"""
SELECT ticker, sector, cluster, cluster_size, cluster = ticker AS is_medoid, mean_intra_dist, score, row_number() OVER (ORDER BY score DESC NULLS LAST, ticker) AS place, var FROM {{pick_score}} UNION ALL
SELECT 'holdings', NULL, NULL, NULL, NULL, NULL, NULL, NULL, quantile_cont(r, 0.05) FROM (SELECT sim_id, arg_max(price, step) - 1 AS r FROM (SELECT sim_id, step, 1 + sum((price - 1) / {len(HELD)}) AS price FROM {{scenarios}} WHERE ticker IN {_held} GROUP BY sim_id, step) AS f GROUP BY sim_id) AS e""")
