"""Queries on windows, rankings, sets and cross-sectional measures."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import network as nw
from ..operators import ranks
from ..operators import windows as wn
from .book import Book
from .surrogates import TEXTS

book = Book()
add = book.add
W_ = "PARTITION BY ticker ORDER BY date"

add("day_over_day", "ticker price:d before:d change_pct:d", lambda t: wn.day_over_day(t("market_daily")), "SELECT ticker, price, before, (price - before) * 100 / before AS change_pct FROM (SELECT ticker, max(CASE WHEN k = 1 THEN close END) AS price, coalesce(max(CASE WHEN k = 2 THEN close END), max(CASE WHEN k = 1 THEN close END)) AS before FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM {market_daily}) AS x GROUP BY ticker) AS y")
add("last_n_rows", "ticker date k", lambda t: wn.last_n_rows(t("returns").where("log_return is not null"), 100, 60), "SELECT ticker, date, k FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM {returns} WHERE log_return IS NOT NULL) AS x WHERE k <= 100")
add("pct_rank_avg", "ticker score:d", lambda t: ranks.average_rank_pct(t("ticker_metadata"), "pe_ratio", "score").withColumn("score", F.col("score") * 100), "SELECT ticker, CASE WHEN pe_ratio IS NOT NULL THEN (rank() OVER (PARTITION BY pe_ratio IS NULL ORDER BY pe_ratio) + (count(*) OVER (PARTITION BY pe_ratio) - 1) / 2) / count(*) OVER (PARTITION BY pe_ratio IS NULL) * 100 END AS score FROM {ticker_metadata}")
TEXTS["pe_scores"] = "SELECT *, CASE WHEN pe IS NOT NULL THEN (rank() OVER (PARTITION BY sector, pe IS NULL ORDER BY pe DESC) + (count(*) OVER (PARTITION BY sector, pe) - 1) / 2) / count(*) OVER (PARTITION BY sector, pe IS NULL) * 100 END AS s, (rank() OVER (ORDER BY market_cap) + (count(*) OVER (PARTITION BY market_cap) - 1) / 2) / count(*) OVER () * 100 AS cap FROM (SELECT *, CASE WHEN pe_ratio > 0 THEN least(pe_ratio, 100.0) END AS pe FROM {ticker_metadata}) AS x"
add("fundamental_score", "ticker fundamental:d", lambda t: wn.fundamental_score(t("ticker_metadata")), "SELECT ticker, round(0.5 * coalesce(s, CASE WHEN p.sector IS NULL THEN mid_all ELSE coalesce(mid, 50) END) + 0.5 * cap + 1e-9, 2) AS fundamental FROM {pe_scores} AS p LEFT JOIN (SELECT sector, quantile_cont(s, 0.5) AS mid FROM {pe_scores} WHERE sector IS NOT NULL GROUP BY sector) AS m ON m.sector = p.sector, (SELECT quantile_cont(s, 0.5) AS mid_all FROM {pe_scores}) AS a")
add("rank_first", "ticker_i ticker_j place", lambda t: ranks.numbered(t("net"), [F.desc("signal_strength"), F.col("ticker_i"), F.col("ticker_j")]), "SELECT ticker_i, ticker_j, row_number() OVER (ORDER BY signal_strength DESC, ticker_i, ticker_j) AS place FROM {net}")
add("cumulative_return", "ticker date cumulative:d", lambda t: wn.cumulative_return(t("returns").where("log_return is not null").withColumn("r", F.exp("log_return") - 1), "r"), f"SELECT ticker, date, exp(sum(log_return) OVER ({W_})) - 1 AS cumulative FROM {{returns}} WHERE log_return IS NOT NULL")
add("max_drawdown", "ticker max_drawdown:d", lambda t: wn.max_drawdown(t("market_data"), "close", ["ticker"], "date"), f"SELECT ticker, min(d) AS max_drawdown FROM (SELECT ticker, close / max(close) OVER ({W_}) - 1 AS d FROM {{market_data}}) AS x GROUP BY ticker")
TEXTS["troughs"] = "SELECT ticker, arg_min(pos, (close, pos)) AS tr FROM {returns} GROUP BY ticker"
add("time_to_recovery", "ticker recovery", lambda t: wn.time_to_recovery(t("returns"), "close", ["ticker"], "pos"),
    "SELECT r.ticker, (SELECT min(b.pos) FROM {returns} AS b WHERE b.ticker = r.ticker AND b.pos > tr AND b.close >= (SELECT max(p.close) FROM {returns} AS p WHERE p.ticker = r.ticker AND p.pos < tr)) - tr AS recovery FROM {troughs} AS r")
add("rolling_mean_20", "ticker date mean_volume:d", lambda t: t("market_data").withColumn("mean_volume", F.avg("volume").over(wn.by_date().rowsBetween(-19, 0))), f"SELECT ticker, date, avg(volume) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean_volume FROM {{market_data}}")
add("ffill", "ticker date close:d", lambda t: wn.ffill(t("market_data").withColumn("close", F.when(F.col("volume") % 3 != 0, F.col("close"))), "close"), f"SELECT ticker, date, last_value(CASE WHEN volume % 3 <> 0 THEN close END IGNORE NULLS) OVER ({W_}) AS close FROM {{market_data}}")
add("index_to_100", "ticker date indexed:d", lambda t: wn.index_to_100(t("market_data")), f"SELECT ticker, date, close / first_value(close) OVER ({W_}) * 100 AS indexed FROM {{market_data}}")
add("daily_pct", "ticker date pct:d", lambda t: wn.daily_pct(t("market_data")), f"SELECT ticker, date, coalesce((close / lag(close) OVER ({W_}) - 1) * 100, 0) AS pct FROM {{market_data}}")
add("yoy_overlay", "ticker day y1999:d y2000:d y2001:d", lambda t: wn.yoy_overlay(t("market_data"), [1999, 2000, 2001]), "SELECT ticker, day, max(CASE WHEN y = 1999 THEN v END) AS y1999, max(CASE WHEN y = 2000 THEN v END) AS y2000, max(CASE WHEN y = 2001 THEN v END) AS y2001 FROM (SELECT ticker, year(date) AS y, row_number() OVER (PARTITION BY ticker, year(date) ORDER BY date) AS day, close / first_value(close) OVER (PARTITION BY ticker, year(date) ORDER BY date) * 100 AS v FROM {market_data} WHERE year(date) >= 1999) AS x GROUP BY ticker, day")
add("cap_per_key", "ticker_i ticker_j place", lambda t: wn.cap_per_key(t("net"), ["ticker_i"], [F.desc("signal_strength"), "ticker_j"], 6), "SELECT ticker_i, ticker_j, place FROM (SELECT *, row_number() OVER (PARTITION BY ticker_i ORDER BY signal_strength DESC, ticker_j) AS place FROM {net}) AS x WHERE place <= 6")
add("topk_by_snapshot", "as_of_date ticker_i ticker_j place", lambda t: wn.cap_per_key(t("edges"), ["as_of_date"], [F.desc("signal_strength"), "ticker_i", "ticker_j"], 15), "SELECT as_of_date, ticker_i, ticker_j, place FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY signal_strength DESC, ticker_i, ticker_j) AS place FROM {edges}) AS x WHERE place <= 15")
TEXTS["top_volume"] = "SELECT d, ticker FROM (SELECT year(date) AS d, ticker, row_number() OVER (PARTITION BY year(date) ORDER BY sum(volume) DESC, ticker) AS k FROM {market_data} GROUP BY year(date), ticker) AS x WHERE k <= 8"
add("topk_persistence", "d persistence:d", lambda t: wn.topk_persistence(wn.cap_per_key(t("market_data").withColumn("d", F.year("date")).groupBy("d", "ticker").agg(F.sum("volume").alias("v")), ["d"], [F.desc("v"), "ticker"], 8), "d", "ticker"),
    "SELECT b.d, sum(CASE WHEN a.ticker IS NOT NULL THEN 1 ELSE 0 END) / (16.0 - sum(CASE WHEN a.ticker IS NOT NULL THEN 1 ELSE 0 END)) AS persistence FROM {top_volume} AS b LEFT JOIN {top_volume} AS a ON a.d = b.d - 1 AND a.ticker = b.ticker WHERE b.d > (SELECT min(d) FROM {top_volume}) GROUP BY b.d")
TEXTS["vols"] = "SELECT m.ticker, pe_ratio, CASE WHEN market_cap % 5 = 0 THEN NULL ELSE vol END AS vol, cap FROM (SELECT ticker, pe_ratio, market_cap, market_cap / 1e6 AS cap FROM {ticker_metadata}) AS m JOIN (SELECT ticker, round(stddev_samp(log_return) + 1e-9, 6) AS vol FROM {returns} GROUP BY ticker) AS v ON v.ticker = m.ticker"
add("vol_fit", "ticker vol_fit:d", lambda t: wn.vol_fit(t("vols"), "vol", 0.05), "SELECT ticker, CASE WHEN vol IS NULL THEN 50 ELSE (1 - (row_number() OVER (PARTITION BY vol IS NULL ORDER BY abs(vol - 0.05), ticker) - 1) / greatest(count(*) OVER (PARTITION BY vol IS NULL) - 1, 1)) * 100 END AS vol_fit FROM {vols}")
add("minmax_rank", "ticker score:d place", lambda t: wn.minmax_rank(t("vols"), {"vol": (0.6, False), "pe_ratio": (0.3, False), "cap": (0.1, True)}),
    "SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, ticker) AS place FROM (SELECT ticker, (coalesce((1 - (vol - v0) / (v1 - v0)) * 0.6, 0) + coalesce((1 - (pe_ratio - p0) / (p1 - p0)) * 0.3, 0) + coalesce((cap - c0) / (c1 - c0) * 0.1, 0)) / (CASE WHEN vol IS NULL THEN 0 ELSE 0.6 END + CASE WHEN pe_ratio IS NULL THEN 0 ELSE 0.3 END + CASE WHEN cap IS NULL THEN 0 ELSE 0.1 END) AS score FROM {vols}, (SELECT min(vol) AS v0, max(vol) AS v1, min(pe_ratio) AS p0, max(pe_ratio) AS p1, min(cap) AS c0, max(cap) AS c1 FROM {vols}) AS e) AS s")

add("top_pairs", "ticker_i ticker_j best_lag sector_i sector_j signal_strength:d", lambda t: t("net").where("signal_strength >= 50").orderBy(F.desc("signal_strength"), "ticker_i", "ticker_j").limit(20), "SELECT * FROM {net} WHERE signal_strength >= 50 ORDER BY signal_strength DESC, ticker_i, ticker_j LIMIT 20")
TEXTS["central"] = "SELECT ticker, max(c) AS centrality, min(sector) AS sector FROM (SELECT ticker_i AS ticker, centrality_i AS c, sector_i AS sector FROM {net} UNION ALL SELECT ticker_j, centrality_j, sector_j FROM {net}) AS x GROUP BY ticker"
add("top_central", "ticker centrality:d", lambda t: nw.node_centrality(t("net")).orderBy(F.desc("centrality"), "ticker").limit(10), "SELECT * FROM {central} ORDER BY centrality DESC, ticker LIMIT 10")
add("top_by_richness", "ticker n", lambda t: t("market_daily").groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ticker").limit(8), "SELECT ticker, count(*) AS n FROM {market_daily} GROUP BY ticker ORDER BY n DESC, ticker LIMIT 8")
add("pick_per_sector", "sector ticker", lambda t: nw.pick_per_sector(t("vols").join(t("ticker_metadata").select("ticker", "sector"), "ticker").withColumn("vol", F.coalesce("vol", F.lit(9.0))), "vol", "cap"), "SELECT sector, ticker FROM (SELECT m.sector, v.ticker, row_number() OVER (PARTITION BY m.sector ORDER BY coalesce(vol, 9), cap, v.ticker) AS k FROM {vols} AS v JOIN {ticker_metadata} AS m ON m.ticker = v.ticker WHERE m.sector IS NOT NULL) AS x WHERE k = 1")
add("top_followers", "ticker_j signal_strength:d", lambda t: t("net").where("ticker_i = 'Brand#12'").orderBy(F.desc("signal_strength"), "ticker_j").limit(8), "SELECT ticker_j, signal_strength FROM {net} WHERE ticker_i = 'Brand#12' ORDER BY signal_strength DESC, ticker_j LIMIT 8")
add("top_clicked", "user_id symbol n place", lambda t: wn.cap_per_key(t("user_clicks").groupBy("user_id", "symbol").agg(F.count(F.lit(1)).alias("n")), ["user_id"], [F.desc("n"), "symbol"], 3), "SELECT * FROM (SELECT user_id, symbol, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, symbol) AS place FROM {user_clicks} GROUP BY user_id, symbol) AS x WHERE place <= 3")

add("union_all", "ticker n", lambda t: t("net").select(F.col("ticker_i").alias("ticker")).unionByName(t("net").select(F.col("ticker_j").alias("ticker"))).groupBy("ticker").agg(F.count(F.lit(1)).alias("n")), "SELECT ticker, count(*) AS n FROM (SELECT ticker_i AS ticker FROM {net} UNION ALL SELECT ticker_j FROM {net}) AS x GROUP BY ticker")
add("ticker_sectors", "ticker sector", lambda t: t("net").select(F.col("ticker_i").alias("ticker"), F.col("sector_i").alias("sector")).union(t("net").select("ticker_j", "sector_j")).groupBy("ticker").agg(F.min("sector").alias("sector")), "SELECT ticker, sector FROM {central}")
add("except_keys", "ticker", lambda t: t("market_data").select("ticker").distinct().join(t("net").where("signal_strength > 90").select(F.col("ticker_i").alias("ticker")), "ticker", "left_anti"), "SELECT ticker FROM {market_data} EXCEPT SELECT ticker_i FROM {net} WHERE signal_strength > 90")
add("intersect_keys", "date", lambda t: t("market_daily").where("ticker = 'Brand#1'").select("date").intersect(t("market_daily").where("ticker = 'Brand#2'").select("date")), "SELECT date FROM {market_daily} WHERE ticker = 'Brand#1' INTERSECT SELECT date FROM {market_daily} WHERE ticker = 'Brand#2'")

TEXTS["panel_pred"] = "SELECT ticker, date, round(log_return * 10, 3) AS pred, lead(log_return) OVER (PARTITION BY ticker ORDER BY date) AS target FROM {returns}"
_pp = "(SELECT * FROM {panel_pred} WHERE pred IS NOT NULL AND target IS NOT NULL)"
pred = lambda t: t("panel_pred").where("pred is not null and target is not null")
add("cross_sectional_ic", "ic:d days", lambda t: wn.cross_sectional_ic(pred(t), "pred", "target"), f"SELECT avg(ic) AS ic, count(ic) AS days FROM (SELECT date, corr(p, q) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY pred) + (count(*) OVER (PARTITION BY date, pred) - 1) / 2 AS p, rank() OVER (PARTITION BY date ORDER BY target) + (count(*) OVER (PARTITION BY date, target) - 1) / 2 AS q FROM {_pp} AS x) AS y GROUP BY date) AS z")
add("long_short", "annual_return:d daily_sharpe:d", lambda t: wn.long_short(pred(t), "pred", "target", 0.2), f"SELECT avg(r) * 252 AS annual_return, avg(r) / stddev_samp(r) AS daily_sharpe FROM (SELECT date, (avg(CASE WHEN u <= k THEN target END) - avg(CASE WHEN d <= k THEN target END)) / 2 AS r FROM (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY date) * 0.2)) AS k, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS u, row_number() OVER (PARTITION BY date ORDER BY pred, ticker) AS d FROM {_pp} AS x) AS y GROUP BY date) AS z")
add("pair_accuracy", "accuracy:d pairs", lambda t: wn.ordered_pair_accuracy(pred(t), "pred", "target"), f"SELECT avg(CASE WHEN a.target > b.target THEN 1.0 ELSE 0 END) AS accuracy, count(*) AS pairs FROM {_pp} AS a JOIN {_pp} AS b ON a.date = b.date AND a.pred > b.pred")
add("tail_accuracy", "accuracy:d pairs", lambda t: wn.ordered_pair_accuracy(pred(t), "pred", "target", 3), f"SELECT avg(CASE WHEN a.target > b.target THEN 1.0 ELSE 0 END) AS accuracy, count(*) AS pairs FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS k FROM {_pp} AS x) AS a JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred, ticker DESC) AS k FROM {_pp} AS x) AS b ON a.date = b.date AND a.pred > b.pred AND a.k <= 3 AND b.k <= 3")
add("lag_entropy", "entropy:d lags", lambda t: wn.lag_entropy(t("net"), "best_lag"), "SELECT sum(-n / total * ln(n / total)) AS entropy, count(*) AS lags FROM (SELECT best_lag, count(*) AS n, sum(count(*)) OVER () AS total FROM {net} GROUP BY best_lag) AS x")
add("feature_panel", "ticker date f1:d f4:d f5:d f6:d target:d",
    lambda t: t("market_data").select("ticker", "date", (F.col("open") / F.col("close")).alias("f1"), (F.col("close") / F.lag("close").over(wn.by_date()) - 1).alias("f4"), F.log1p("volume").alias("f5"), F.when(F.count("volume").over(wn.by_date().rowsBetween(-19, 0)) == 20, F.col("volume") / F.greatest(F.avg("volume").over(wn.by_date().rowsBetween(-19, 0)), F.lit(1.0))).alias("f6"), (F.lead("close").over(wn.by_date()) / F.col("close") - 1).alias("target")).where("f4 is not null and f6 is not null and target is not null"),
    f"SELECT * FROM (SELECT ticker, date, open / close AS f1, close / lag(close) OVER ({W_}) - 1 AS f4, ln(1 + volume) AS f5, CASE WHEN count(volume) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN volume / greatest(avg(volume) OVER ({W_} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 1.0) END AS f6, lead(close) OVER ({W_}) / close - 1 AS target FROM {{market_data}}) AS x WHERE f4 IS NOT NULL AND f6 IS NOT NULL AND target IS NOT NULL")
add("lag_windows", "ticker lag step close:d", lambda t: t("market_data").withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))).withColumn("lag", F.explode(F.array(*map(F.lit, (1, 2, 5))))).withColumn("step", F.col("k") - F.col("lag")).where("step between 1 and 20"),
    "SELECT ticker, lag, k - lag AS step, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM {market_data}) AS x, (SELECT unnest([1, 2, 5]) AS lag) AS l WHERE k - lag BETWEEN 1 AND 20")
