"""Queries on pairs, factor models, aggregates, strategy, stability and scoring."""

import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import network as nw
from ..operators import pairs as pr
from ..operators import stats as st
from ..sources import scans as sc
from .book import Book
from .pairs import partialled
from .surrogates import MADE, TEXTS

book = Book()
add = book.add
TEXTS["excess"] = "SELECT r.ticker, r.date, log_return - rf AS y, mkt_rf, smb, hml, sector FROM {returns} AS r JOIN {ff_factors} AS f ON r.date = f.date JOIN {ticker_metadata} AS m ON m.ticker = r.ticker WHERE log_return IS NOT NULL"
_ex = "SELECT * FROM {excess}"


def excess(t):
    return t("returns").where("log_return is not null").join(t("ff_factors"), "date").join(t("ticker_metadata").select("ticker", "sector"), "ticker").withColumn("y", F.col("log_return") - F.col("rf"))


add("prices_x_factors", "ticker date y:d mkt_rf:d", excess, f"SELECT ticker, date, y, mkt_rf FROM ({_ex}) AS e")
add("stats_x_meta", "ticker n_days market_cap", lambda t: st.ticker_stats(t("market_data")).join(t("ticker_metadata").where("market_cap % 2 = 0"), "ticker", "left").withColumn("market_cap", F.coalesce("market_cap", F.lit(0))),
    "SELECT s.ticker, n_days, coalesce(market_cap, 0) AS market_cap FROM (SELECT ticker, count(*) AS n_days FROM {market_data} GROUP BY ticker) AS s LEFT JOIN (SELECT * FROM {ticker_metadata} WHERE market_cap % 2 = 0) AS m ON s.ticker = m.ticker")
add("attach_sectors", "ticker_i ticker_j sector_a sector_b", lambda t: pr.all_pairs(t("ticker_metadata")).join(t("ticker_metadata").select(F.col("ticker").alias("ticker_i"), F.coalesce("sector", F.lit("Unknown")).alias("sector_a")), "ticker_i", "left").join(t("ticker_metadata").select(F.col("ticker").alias("ticker_j"), F.coalesce("sector", F.lit("Unknown")).alias("sector_b")), "ticker_j", "left"),
    "SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, coalesce(a.sector, 'Unknown') AS sector_a, coalesce(b.sector, 'Unknown') AS sector_b FROM {ticker_metadata} AS a JOIN {ticker_metadata} AS b ON a.ticker < b.ticker")
add("all_pairs", "ticker_i ticker_j", lambda t: pr.all_pairs(t("ticker_metadata")), "SELECT a.ticker AS ticker_i, b.ticker AS ticker_j FROM {ticker_metadata} AS a JOIN {ticker_metadata} AS b ON a.ticker < b.ticker")
add("sector_pairs", "ticker_i ticker_j sector", lambda t: pr.sector_pairs(t("ticker_metadata")), "SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, a.sector FROM {ticker_metadata} AS a JOIN {ticker_metadata} AS b ON a.ticker < b.ticker AND a.sector = b.sector")
add("ticker_stats", "ticker n_days first_date last_date median_dollar_volume:d", lambda t: st.ticker_stats(t("market_daily")), "SELECT ticker, count(*) AS n_days, min(date) AS first_date, max(date) AS last_date, quantile_cont(close * volume, 0.5) AS median_dollar_volume FROM {market_daily} GROUP BY ticker")
TEXTS["universe"] = "SELECT *, CASE WHEN n_days < 252 THEN 'insufficient_history' WHEN coverage < 0.75 THEN 'low_coverage' WHEN mdv < 20000 THEN 'low_volume' WHEN market_cap < 1500000 THEN 'low_market_cap' ELSE 'OK' END AS reason FROM (SELECT s.ticker, n_days, n_days / 1725.0 AS coverage, mdv, coalesce(market_cap, 0) AS market_cap FROM (SELECT ticker, count(*) AS n_days, quantile_cont(close * volume, 0.5) AS mdv FROM {market_daily} GROUP BY ticker) AS s LEFT JOIN {ticker_metadata} AS m ON m.ticker = s.ticker) AS x"
_uni = "SELECT * FROM {universe}"


def universe(t):
    return st.universe_filter(t("market_daily"), t("ticker_metadata"), 2499, 1.0, 0.75, 20000.0, 1500000.0)


add("universe_filter", "ticker n_days coverage:d market_cap reason is_valid", universe, f"SELECT *, reason = 'OK' AS is_valid FROM ({_uni}) AS u")
add("valid_tickers", "ticker", lambda t: universe(t).where("is_valid").orderBy("ticker"), f"SELECT ticker FROM ({_uni}) AS u WHERE reason = 'OK'")
add("reason_counts", "reason n", lambda t: universe(t).where("not is_valid").groupBy("reason").agg(F.count(F.lit(1)).alias("n")), f"SELECT reason, count(*) AS n FROM ({_uni}) AS u WHERE reason <> 'OK' GROUP BY reason")


add("ols_residuals", "ticker date residual:d", lambda t: st.ols_residuals(excess(t), ["ticker"], "y", ["mkt_rf", "smb", "hml"]), f"SELECT ticker, date, y AS residual FROM ({partialled(_ex, 'y', ['mkt_rf', 'smb', 'hml'], 'ticker')}) AS r")
TEXTS["excess_loo"] = f"SELECT *, CASE WHEN count(*) OVER (PARTITION BY date, sector) > 1 THEN (sum(y) OVER (PARTITION BY date, sector) - y) / (count(*) OVER (PARTITION BY date, sector) - 1) END AS loo FROM ({_ex}) AS e"
_loo = "SELECT * FROM {excess_loo}"
add("loo_sector_factor", "ticker date loo:d", lambda t: st.loo_sector_factor(excess(t), "y"), f"SELECT ticker, date, loo FROM ({_loo}) AS l")
_use = f"SELECT ticker AS tk FROM ({_loo}) AS l GROUP BY ticker HAVING avg(CASE WHEN loo IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.9"
_plain = partialled(f"SELECT ticker, date, y, mkt_rf, smb, hml FROM ({_loo}) AS l WHERE ticker NOT IN ({_use})", "y", ["mkt_rf", "smb", "hml"], "ticker")
_sect = partialled(f"SELECT ticker, date, y, mkt_rf, smb, hml, coalesce(loo, 0) AS loo FROM ({_loo}) AS l WHERE ticker IN ({_use})", "y", ["mkt_rf", "smb", "hml", "loo"], "ticker")
add("sector_residuals", "ticker date residual:d factor_model", lambda t: st.sector_residuals(excess(t), "y", ["mkt_rf", "smb", "hml"]), f"SELECT ticker, date, y AS residual, 'sector' AS factor_model FROM ({_sect}) AS a UNION ALL SELECT ticker, date, y, 'plain' FROM ({_plain}) AS b")
TEXTS["window_excess"] = "SELECT w.window_start, w.win, w.ticker, w.date, log_return - rf AS y, mkt_rf, smb, hml FROM {window_returns} AS w JOIN {ff_factors} AS f ON f.date = w.date"
TEXTS["residuals"] = f"SELECT window_start, win, ticker, date, y AS residual FROM ({partialled('SELECT *, count(*) OVER (PARTITION BY win, ticker) AS n FROM {window_excess}', 'y', ['mkt_rf', 'smb', 'hml'], 'win, ticker')}) AS r WHERE n >= 40"


def residuals(t):
    rows = t("returns").join(t("ff_factors"), "date").withColumn("y", F.col("log_return") - F.col("rf"))
    return st.rolling_residuals(rows, t("windows"), "y", ["mkt_rf", "smb", "hml"], 40)


MADE["residuals"] = residuals
add("scan_residuals", "window_start ticker date residual:d", lambda t: sc.matching(t("residuals"), window_start=datetime.date(1999, 1, 1)), "SELECT * FROM {residuals} WHERE window_start = DATE '1999-01-01'")
add("rolling_residuals", "window_start ticker date residual:d", residuals, "SELECT * FROM {residuals}")
add("latest_residual", "ticker date residual:d", lambda t: st.one_residual(t("residuals")), "SELECT ticker, date, arg_max(residual, win) AS residual FROM {residuals} GROUP BY ticker, date")
add("causal_residual", "ticker date residual:d", lambda t: st.one_residual(t("residuals"), "causal"), "SELECT ticker, date, arg_min(residual, win) AS residual FROM {residuals} GROUP BY ticker, date")
add("nearest_price", "ticker past_date past_close:d", lambda t: nw.nearest_price(t("market_daily"), t("market_daily").agg(F.date_sub(F.max("date"), 182))), """
SELECT ticker, date AS past_date, close AS past_close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(date - (SELECT max(date) - 182 FROM {market_daily})), date) AS k FROM {market_daily} WHERE abs(date - (SELECT max(date) - 182 FROM {market_daily})) <= 7) AS x WHERE k = 1""")
add("trailing_zscore", "ticker date z:d", lambda t: st.trailing_zscore(t("returns").where("log_return is not null"), "log_return", 52),
    "SELECT ticker, date, CASE WHEN c = 52 AND s > 1e-10 THEN (log_return - m) / s END AS z FROM (SELECT *, count(log_return) OVER w AS c, avg(log_return) OVER w AS m, stddev_pop(log_return) OVER w AS s FROM {returns} WHERE log_return IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)) AS x")
_W = {"mean_dcor": 2.0, "frequency": 0.5, "sharpness": -0.25}
add("predicted_score", "ticker_i ticker_j predicted:d", lambda t: st.predicted_score(t("net"), _W, 0.1), "SELECT ticker_i, ticker_j, 0.1 + 2.0 * coalesce(mean_dcor, 0) + 0.5 * coalesce(frequency, 0) - 0.25 * coalesce(sharpness, 0) AS predicted FROM {net}")
add("signal_strength", "ticker_i ticker_j signal_strength:d", lambda t: st.signal_strength(t("net").drop("signal_strength"), "mean_dcor"), "SELECT ticker_i, ticker_j, CASE WHEN hi > lo THEN (least(greatest(mean_dcor, lo), hi) - lo) / (hi - lo) * 100 ELSE 50 END AS signal_strength FROM {net}, (SELECT quantile_cont(mean_dcor, 0.05) AS lo, quantile_cont(mean_dcor, 0.95) AS hi FROM {net}) AS p")
TEXTS["annual_vols"] = """
SELECT ticker, stddev_samp(r) * sqrt(252) AS vol FROM (SELECT ticker, ln(adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM {market_daily} WHERE date > (SELECT max(date) - 365 FROM {market_daily})) AS x GROUP BY ticker HAVING count(r) >= 50"""
add("annualized_vol", "ticker vol:d", lambda t: st.annualized_vol(t("market_daily")), "SELECT * FROM {annual_vols}")
add("lag_distribution", "best_lag n mean_score:d mean_sharpe:d", lambda t: t("net").groupBy("best_lag").agg(F.count(F.lit(1)).alias("n"), F.avg("signal_strength").alias("mean_score"), F.avg("oos_sharpe_net").alias("mean_sharpe")), "SELECT best_lag, count(*) AS n, avg(signal_strength) AS mean_score, avg(oos_sharpe_net) AS mean_sharpe FROM {net} GROUP BY best_lag")
add("decile_performance", "decile mean_value:d median_value:d n mean_score:d", lambda t: st.deciles(t("net"), "signal_strength", "oos_sharpe_net"),
    "SELECT greatest(1, len(list_filter(e, lambda x: x < signal_strength))) AS decile, avg(oos_sharpe_net) AS mean_value, quantile_cont(oos_sharpe_net, 0.5) AS median_value, count(*) AS n, avg(signal_strength) AS mean_score FROM {net}, (SELECT list_distinct(quantile_cont(signal_strength, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM {net}) AS q GROUP BY 1")
add("robust_scale", "ticker_i ticker_j mean_dcor:d sharpness:d", lambda t: st.robust_scale(t("net"), ["mean_dcor", "sharpness"]), "SELECT ticker_i, ticker_j, (mean_dcor - a[2]) / CASE WHEN a[3] = a[1] THEN 1 ELSE a[3] - a[1] END AS mean_dcor, (sharpness - b[2]) / CASE WHEN b[3] = b[1] THEN 1 ELSE b[3] - b[1] END AS sharpness FROM {net}, (SELECT quantile_cont(mean_dcor, [0.25, 0.5, 0.75]) AS a, quantile_cont(sharpness, [0.25, 0.5, 0.75]) AS b FROM {net}) AS q")
add("drop_correlated", "ticker n_features", lambda t: t("ticker_metadata").select("ticker").withColumn("n_features", F.lit(len(st.drop_correlated(t("market_data"), ["open", "close", "adj_close", "volume"])))),
    "SELECT ticker, CAST(1 + CASE WHEN abs(oc) > 0.85 THEN 0 ELSE 1 END + CASE WHEN abs(oa) > 0.85 OR abs(ca) > 0.85 THEN 0 ELSE 1 END + CASE WHEN abs(ov) > 0.85 OR abs(cv) > 0.85 OR abs(av) > 0.85 THEN 0 ELSE 1 END AS INT) AS n_features FROM {ticker_metadata}, (SELECT corr(open, close) AS oc, corr(open, adj_close) AS oa, corr(close, adj_close) AS ca, corr(open, volume) AS ov, corr(close, volume) AS cv, corr(adj_close, volume) AS av FROM {market_data}) AS c")
add("drift_vol", "ticker drift:d vol:d", lambda t: t("returns").groupBy("ticker").agg((F.avg("log_return") * 252).alias("drift"), (F.stddev_samp("log_return") * F.sqrt(F.lit(252.0))).alias("vol")), "SELECT ticker, avg(log_return) * 252 AS drift, stddev_samp(log_return) * sqrt(252) AS vol FROM {returns} GROUP BY ticker")
add("sortino", "ticker sortino:d", lambda t: t("returns").groupBy("ticker").agg(st.sortino("log_return").alias("sortino")), "SELECT ticker, avg(log_return) * 252 / (stddev_samp(CASE WHEN log_return < 0 THEN log_return END) * sqrt(252)) AS sortino FROM {returns} GROUP BY ticker")
_dq = f"SELECT ticker_i, ticker_j, signal_strength > 90 AS truth, frequency > 0.5 AS significant, mean_dcor AS dcor FROM {{net}}"
add("detection_quality", "tpr:d fpr:d rank_accuracy:d status", lambda t: st.detection_quality(t("net").select((F.col("signal_strength") > 90).alias("truth"), (F.col("frequency") > 0.5).alias("significant"), F.col("mean_dcor").alias("dcor")), 20),
    f"SELECT *, CASE WHEN tpr >= 0.7 AND fpr <= 0.1 THEN 'PASS' ELSE 'WARN' END AS status FROM (SELECT count(*) FILTER (truth AND significant) / nullif(count(*) FILTER (truth), 0) AS tpr, count(*) FILTER (NOT truth AND significant) / nullif(count(*) FILTER (NOT truth), 0) AS fpr, count(*) FILTER (truth AND r <= 20) / nullif(count(*) FILTER (truth), 0) AS rank_accuracy FROM (SELECT *, rank() OVER (ORDER BY dcor DESC) + (count(*) OVER (PARTITION BY dcor) - 1) / 2 AS r FROM ({_dq}) AS d) AS e) AS f")
