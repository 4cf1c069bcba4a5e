"""Queries on pairs by window: alignment, lagged dependence, tests, stability, scoring."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import network as nw
from ..operators import pairs as pr
from ..operators import stats as st
from ..sources import scans as sc
from .book import Book
from .surrogates import MADE, TEXTS

book = Book()
add = book.add
LAGS = (1, 2, 3)
PAIR = ["ticker_i", "ticker_j"]
#: A pair counts as significant in a window from this dCor on; FDR has a query of its own.
SIGNIFICANT = 0.30


# Windows: a year from each quarter on that the data covers.

TEXTS["windows"] = """
SELECT window_start, window_end, CAST(year(window_start) * 4 + quarter(window_start) AS INT) AS win FROM (
 SELECT window_start, CAST(window_start + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS window_end FROM (SELECT DISTINCT CAST(date_trunc('quarter', date) AS DATE) AS window_start FROM {market_data}) AS q) AS w
WHERE window_end <= (SELECT max(date) FROM {market_data})"""
TEXTS["window_returns"] = "SELECT window_start, win, ticker, date, log_return FROM {returns} JOIN {windows} ON date BETWEEN window_start AND window_end WHERE log_return IS NOT NULL"


def windows(t):
    last = t("market_data").agg(F.max("date").alias("last"))
    every = cal.quarters(t("market_data")).join(F.broadcast(last)).where("window_end <= last")  # one row
    return every.select("window_start", "window_end", (F.year("window_start") * 4 + F.quarter("window_start")).alias("win"))


def window_returns(t):
    # four windows a year: a calendar's length bounds what is broadcast
    inside = F.col("date").between(F.col("window_start"), F.col("window_end"))
    return t("returns").where("log_return is not null").join(F.broadcast(t("windows")), inside).select("window_start", "win", "ticker", "date", "log_return")


MADE["windows"], MADE["window_returns"] = windows, window_returns


def pairs_of(t, keys=()):
    """Both series of every ticker pair: of every window with keys window_start and win."""
    rows = t("window_returns") if keys else t("returns")
    return pr.paired(pr.series_arrays(rows, keys=keys), pr.all_pairs(rows.select("ticker").distinct()))


def by_window(t):
    return pairs_of(t, ["window_start", "win"])


# Alignment over the whole history.

TEXTS["aligned"] = """
SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, a.date, a.log_return AS x, b.log_return AS y,
 row_number() OVER (PARTITION BY a.ticker, b.ticker ORDER BY a.date) AS pos, count(*) OVER (PARTITION BY a.ticker, b.ticker) AS n
FROM {returns} AS a JOIN {returns} AS b ON a.date = b.date AND a.ticker < b.ticker WHERE a.log_return IS NOT NULL AND b.log_return IS NOT NULL"""
_lags = "(SELECT unnest([1, 2, 3]) AS lag) AS l"
TEXTS["lagged"] = f"""
SELECT p.ticker_i, p.ticker_j, lag, p.pos, p.x, q.y FROM {{aligned}} AS p JOIN {_lags} ON true
JOIN {{aligned}} AS q ON p.ticker_i = q.ticker_i AND p.ticker_j = q.ticker_j AND q.pos = p.pos + lag WHERE p.n >= 20 AND p.n > lag + 4"""

add("pair_align", "ticker_i ticker_j date x:d y:d pos n", lambda t: pr.aligned(pairs_of(t)), "SELECT * FROM {aligned} WHERE n >= 20")
add("lag_align", "ticker_i ticker_j lag pos x:d y:d", lambda t: pr.lagged(pairs_of(t), LAGS), "SELECT * FROM {lagged}")
add("lead_lag_beta", "ticker_i ticker_j lag corr:d beta:d obs", lambda t: pr.lead_lag_beta(pairs_of(t), LAGS), """
SELECT ticker_i, ticker_j, lag, corr, beta, obs FROM (SELECT *, row_number() OVER (PARTITION BY ticker_i, ticker_j ORDER BY round(abs(corr), 9) DESC, lag) AS k FROM (
 SELECT ticker_i, ticker_j, lag, corr(x, y) AS corr, regr_slope(y, x) AS beta, count(*) AS obs FROM {lagged} GROUP BY ticker_i, ticker_j, lag HAVING count(*) >= 30) AS g) AS r WHERE k = 1""")
add("corr_matrix", "ticker_i ticker_j corr:d", lambda t: pr.correlation_matrix(pairs_of(t)), """
SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, corr(a.log_return, b.log_return) AS corr FROM {returns} AS a JOIN {returns} AS b ON a.date = b.date GROUP BY a.ticker, b.ticker""")


# Profiles of every window.

TEXTS["w_aligned"] = """
SELECT a.window_start, a.win, a.ticker AS ticker_i, b.ticker AS ticker_j, a.log_return AS x, b.log_return AS y,
 row_number() OVER (PARTITION BY a.win, a.ticker, b.ticker ORDER BY a.date) AS pos, count(*) OVER (PARTITION BY a.win, a.ticker, b.ticker) AS n
FROM {window_returns} AS a JOIN {window_returns} AS b ON a.win = b.win AND a.date = b.date AND a.ticker < b.ticker"""
TEXTS["w_lagged"] = f"""
SELECT p.window_start, p.win, p.ticker_i, p.ticker_j, lag, p.pos, p.x, q.y FROM {{w_aligned}} AS p JOIN {_lags} ON true
JOIN {{w_aligned}} AS q ON p.win = q.win AND p.ticker_i = q.ticker_i AND p.ticker_j = q.ticker_j AND q.pos = p.pos + lag WHERE p.n >= 20 AND p.n > lag + 4"""


def dcor_sql(rows: str) -> str:
    """Distance correlation of x and y of {rows}(window_start, win, ticker_i, ticker_j, lag, pos, x, y)
    in SQL, grouped by one number g for those keys, so that grouping stays small."""
    TEXTS[f"{rows}_g"] = f"SELECT *, hash(win, ticker_i, ticker_j, lag) AS g FROM {{{rows}}}"
    TEXTS[f"{rows}_v"] = f"""
SELECT g, count(*) AS obs, sum(sab) / count(*) ** 2 - 2 * avg(ra * rb) + avg(ra) * avg(rb) AS vab, sum(saa) / count(*) ** 2 - 2 * avg(ra * ra) + avg(ra) ** 2 AS va, sum(sbb) / count(*) ** 2 - 2 * avg(rb * rb) + avg(rb) ** 2 AS vb FROM (
 SELECT p.g, p.pos, avg(abs(p.x - q.x)) AS ra, avg(abs(p.y - q.y)) AS rb, sum(abs(p.x - q.x) * abs(p.y - q.y)) AS sab, sum(abs(p.x - q.x) ** 2) AS saa, sum(abs(p.y - q.y) ** 2) AS sbb
 FROM {{{rows}_g}} AS p JOIN {{{rows}_g}} AS q ON p.g = q.g GROUP BY p.g, p.pos) AS r GROUP BY g"""
    return f"""
SELECT window_start, win, ticker_i, ticker_j, lag, obs, CASE WHEN va <= 1e-14 OR vb <= 1e-14 THEN 0 ELSE sqrt(least(1, greatest(0, vab / sqrt(va * vb)))) END AS dcor
FROM (SELECT DISTINCT g, window_start, win, ticker_i, ticker_j, lag FROM {{{rows}_g}}) AS k JOIN {{{rows}_v}} AS v ON v.g = k.g"""


TEXTS["w_dcor"] = dcor_sql("w_lagged")
TEXTS["w_pearson"] = "SELECT window_start, win, ticker_i, ticker_j, lag, count(*) AS obs, corr(x, y) AS pearson FROM {w_lagged} GROUP BY ALL"
TEXTS["w_sharp"] = """
SELECT win, ticker_i, ticker_j, CASE WHEN count(*) = 1 THEN 1 ELSE 1 - (ln(sum(dcor)) - sum(dcor * ln(dcor)) / sum(dcor)) / ln(count(*)) END AS sharpness, max(dcor) / sum(dcor) AS ratio
FROM {w_dcor} WHERE dcor > 0 GROUP BY win, ticker_i, ticker_j"""
MADE["w_dcor"] = lambda t: pr.dcor_lag(by_window(t), LAGS)
_W = "window_start ticker_i ticker_j"
W_ = ["window_start", "win", *PAIR]

add("pearson_lag", _W + " lag obs pearson:d", lambda t: pr.pearson_lag(by_window(t), LAGS), "SELECT * FROM {w_pearson}")
add("dcor", _W + " dcor:d", lambda t: pr.dcor_lag(by_window(t), (1,)), "SELECT * FROM {w_dcor} WHERE lag = 1")
add("dcor_lag_profile", _W + " lag obs dcor:d", lambda t: pr.dcor_lag(by_window(t), LAGS), "SELECT * FROM {w_dcor}")
add("sharpness", "win ticker_i ticker_j sharpness:d", lambda t: pr.sharpness(t("w_dcor"), W_), "SELECT * FROM {w_sharp}")
add("sharpness_ratio", "win ticker_i ticker_j sharpness:d", lambda t: pr.sharpness(t("w_dcor"), W_, "ratio"), "SELECT win, ticker_i, ticker_j, ratio AS sharpness FROM {w_sharp}")
add("best_lag", "win ticker_i ticker_j best_lag dcor:d", lambda t: pr.best_lag(t("w_dcor"), W_),
    "SELECT win, ticker_i, ticker_j, lag AS best_lag, dcor FROM (SELECT *, row_number() OVER (PARTITION BY win, ticker_i, ticker_j ORDER BY round(dcor, 9) DESC, lag) AS k FROM {w_dcor}) AS x WHERE k = 1")
# Permutations have no SQL: pairs x lags x permutations x rows squared is too much for it on whole
# tables; tests hold them against a plain loop.
add("permutation_p", _W + " lag dcor:d p_value:d permutations", lambda t: pr.permutation_p(by_window(t), LAGS))
add("tier_budget", "tier3_fraction:d alert", lambda t: pr.tier_budget(pr.permutation_p(by_window(t), LAGS)))
add("pair_panel", _W + " lag dcor:d p_value:d permutations sharpness:d pearson:d", lambda t: pr.pair_panel(by_window(t), LAGS))


# The chain: permutations that stop where FDR control can't be passed any more, q-values, stability
# of what is significant. It has no SQL either; tests hold it against plain loops.

ALPHA = 0.05


def significant_permuted(t):
    found = pr.bh_fdr(t("tested"), ALPHA, choose="dcor").where("significant")
    return st.with_sharpness(found.select("window_start", "win", *PAIR, "lag", "dcor"), t("w_dcor").join(pr.sharpness(t("w_dcor"), W_), W_), W_)


MADE["tested"] = lambda t: pr.permutation_p(by_window(t), LAGS, alpha=ALPHA)
add("bh_fdr_permuted", _W + " lag dcor:d p_value:d permutations q_value:d significant", lambda t: pr.bh_fdr(t("tested"), ALPHA, choose="dcor"))
add("stability_permuted", "ticker_i ticker_j mean_dcor:d variance_dcor:d frequency:d best_lag sharpness:d n_windows_observed half_life:d half_life_r2:d", lambda t: st.stability(significant_permuted(t), t("windows")))


def daily_pairs(t):
    """Both series of every pair and window of daily returns: about 250 rows."""
    inside = F.col("date").between(F.col("window_start"), F.col("window_end"))
    rows = t("daily_returns").join(F.broadcast(t("windows")), inside).select("window_start", "win", "ticker", "date", "log_return")  # a calendar
    return pr.paired(pr.series_arrays(rows, keys=["window_start", "win"]), pr.all_pairs(rows.select("ticker").distinct()))


add("permutation_daily", _W + " lag dcor:d p_value:d permutations", lambda t: pr.permutation_p(daily_pairs(t), LAGS))
add("bh_fdr_daily", _W + " lag dcor:d p_value:d permutations q_value:d significant", lambda t: pr.bh_fdr(pr.permutation_p(daily_pairs(t), LAGS, alpha=ALPHA), ALPHA, choose="dcor"))


def backfilled(t):
    keys = ["window_start", *PAIR, "lag"]
    fresh = pr.pearson_lag(by_window(t), LAGS)
    stored = fresh.withColumn("pearson", F.when(F.col("lag") != 2, F.col("pearson")))
    missing = stored.where("pearson is null").select(*keys)
    return sc.keyed_update(stored, fresh.where("obs >= 20").join(missing, keys, "left_semi"), keys, "pearson")


add("pearson_backfill", _W + " lag pearson:d", backfilled, "SELECT * REPLACE (CASE WHEN lag <> 2 OR obs >= 20 THEN pearson END AS pearson) FROM {w_pearson}")
add("direction_counts", "positive negative unknown", lambda t: pr.direction_counts(t("panel")), """
SELECT count(*) FILTER (pearson > 0) AS positive, count(*) FILTER (pearson < 0) AS negative, count(*) FILTER (pearson IS NULL) AS unknown FROM {panel}""")

#: p-values that SQL can draw as well: the leading digits of an md5.
TEXTS["p_values"] = """
SELECT as_of_date AS window_start, ticker_i, ticker_j, lag, abs(pearson) AS strength, (('0x' || substr(md5(concat(ticker_i, '/', ticker_j, '/', lag)), 1, 8))::BIGINT % 100000 + 1) / 1e5 * abs(pearson) AS p_value FROM {panel}"""


def p_values(t):
    draw = F.conv(F.substring(F.md5(F.concat_ws("/", *PAIR, F.col("lag").cast("string"))), 1, 8), 16, 10).cast("long")
    return t("panel").select(F.col("as_of_date").alias("window_start"), *PAIR, "lag", F.abs("pearson").alias("strength"), ((draw % 100000 + 1) / F.lit(1e5) * F.abs("pearson")).alias("p_value"))


def bh_sql(rows: str) -> str:
    return f"""
SELECT *, q_value <= 0.02 AS significant FROM (
 SELECT *, least(1.0, min(raw) OVER (PARTITION BY window_start ORDER BY p_value, ticker_i, ticker_j, lag ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM (
  SELECT *, p_value * count(*) OVER (PARTITION BY window_start) / row_number() OVER (PARTITION BY window_start ORDER BY p_value, ticker_i, ticker_j, lag) AS raw FROM {rows}) AS r) AS q"""


_BH = "window_start ticker_i ticker_j lag q_value:d significant"
add("bh_fdr", _BH, lambda t: pr.bh_fdr(p_values(t), 0.02, choose="strength"), bh_sql("""(
   SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, ticker_i, ticker_j ORDER BY round(strength, 9) DESC, lag) AS k FROM {p_values} WHERE strength > 0) AS c WHERE k = 1) AS p"""))
add("bh_fdr_all_lags", _BH, lambda t: pr.bh_fdr(p_values(t), 0.02), bh_sql("{p_values}"))


# The panel by snapshot, and the network scored from it.

def as_of_panel(t):
    dates = F.explode(F.array(*[F.lit(d).cast("date") for d in ("2000-12-31", "2001-12-31")]))
    rows = t("returns").withColumn("as_of_date", dates).where("date <= as_of_date")
    both = pr.paired(pr.series_arrays(rows, keys=["as_of_date"]), pr.all_pairs(rows.select("ticker").distinct()))
    return pr.pearson_lag(both, LAGS).withColumnRenamed("obs", "n")


def edges(t):
    a, tidy = F.abs("pearson"), lambda c: F.round(c + 1e-9, 6)
    keys = ["as_of_date", *PAIR]
    per = t("panel").groupBy(*keys).agg(
        tidy(F.max(a)).alias("mean_dcor"), tidy(F.var_pop(a)).alias("variance_dcor"), tidy(F.avg((a > 0.05).cast("double"))).alias("frequency"),
        F.max_by("lag", F.struct(F.round(a, 9), -F.col("lag"))).alias("best_lag"), tidy(F.try_divide(F.max(a), F.sum(a))).alias("sharpness"), tidy(F.sum("pearson")).alias("oos_sharpe_net"),
    )
    out = st.signal_strength(per, "mean_dcor", ["as_of_date"]).withColumn("signal_strength", tidy(F.col("signal_strength"))).withColumn("half_life", 21.0 * F.col("best_lag"))
    for x in "ij":
        sector = t("ticker_metadata").select(F.col("ticker").alias(f"ticker_{x}"), F.col("sector").alias(f"sector_{x}"))
        central = out.groupBy("as_of_date", f"ticker_{x}").agg(tidy(F.avg("signal_strength") / 100).alias(f"centrality_{x}"))
        out = out.join(sector, f"ticker_{x}", "left").join(central, ["as_of_date", f"ticker_{x}"])
    return out


MADE["panel"], MADE["edges"] = as_of_panel, edges
MADE["net"] = lambda t: t("edges").where("as_of_date = date '2001-12-31'")
MADE["centrals"] = lambda t: nw.node_centrality(t("net"))


# Stability over windows.

TEXTS["sig"] = f"""
SELECT x.window_start, x.win, x.ticker_i, x.ticker_j, lag, dcor, sharpness FROM (
 SELECT *, row_number() OVER (PARTITION BY win, ticker_i, ticker_j ORDER BY round(dcor, 9) DESC, lag) AS k FROM {{w_dcor}} WHERE dcor >= {SIGNIFICANT}) AS x
JOIN {{w_sharp}} AS s ON s.win = x.win AND s.ticker_i = x.ticker_i AND s.ticker_j = x.ticker_j WHERE k = 1"""


def significant(t):
    best = pr.best_lag(t("w_dcor").where(F.col("dcor") >= SIGNIFICANT), W_).withColumnRenamed("best_lag", "lag")
    profile = t("w_dcor").join(pr.sharpness(t("w_dcor"), W_), W_)  # a row a lag, as stored
    return st.with_sharpness(best, profile, W_)


MADE["sig"] = significant
_SSE = "sum(dcor * dcor) - 2 * greatest(sum(dcor * exp(-rate * t)) / sum(exp(-2 * rate * t)), 0) * sum(dcor * exp(-rate * t)) + greatest(sum(dcor * exp(-rate * t)) / sum(exp(-2 * rate * t)), 0) ** 2 * sum(exp(-2 * rate * t))"
TEXTS["decay"] = "SELECT *, win - min(win) OVER (PARTITION BY ticker_i, ticker_j) AS t FROM {sig}"
TEXTS["coarse_rate"] = f"""
SELECT ticker_i, ticker_j, g, rate, 10.0 ** (-6.0 + greatest(g - 1, 0) * (7.0 / 40)) AS lo, 10.0 ** (-6.0 + least(g + 1, 40) * (7.0 / 40)) AS hi
FROM (SELECT *, row_number() OVER (PARTITION BY ticker_i, ticker_j ORDER BY round(sse, 12), rate) AS k FROM (
 SELECT ticker_i, ticker_j, g, rate, {_SSE} AS sse FROM {{decay}} JOIN (SELECT g, 10.0 ** (-6.0 + g * (7.0 / 40)) AS rate FROM range(41) AS r(g)) AS g ON true GROUP BY 1, 2, 3, 4) AS s) AS z WHERE k = 1"""


def slope_sql(r: str) -> str:
    """The slope of the fit's quality in the rate r over a pair's list p of points (t, y)."""
    total = lambda x: f"list_sum(list_transform(p, lambda v: {x}))"
    e, e2 = f"exp(-({r}) * v.t)", f"exp(-2 * ({r}) * v.t)"
    return f"({total(f'v.y * {e}')} * {total(f'v.t * {e2}')} - {total(f'v.t * v.y * {e}')} * {total(e2)})"


TEXTS["decay_points"] = "SELECT ticker_i, ticker_j, list({'t': t::DOUBLE, 'y': dcor} ORDER BY t) AS p FROM {decay} GROUP BY 1, 2"
_halved = f"""list_reduce(list_prepend({{'lo': lo::DOUBLE, 'hi': hi::DOUBLE}}, list_transform(range(60), lambda i: {{'lo': 0e0, 'hi': 0e0}})),
 lambda s, x: CASE WHEN {slope_sql('sqrt(s.lo * s.hi)')} > 0 THEN {{'lo': sqrt(s.lo * s.hi), 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': sqrt(s.lo * s.hi)}} END)"""
TEXTS["best_rate"] = f"""
SELECT ticker_i, ticker_j, CASE WHEN {slope_sql('lo')} > 0 AND {slope_sql('hi')} < 0 THEN sqrt(b.lo * b.hi) ELSE rate END AS rate
FROM (SELECT c.ticker_i, c.ticker_j, rate, lo, hi, p, {_halved} AS b FROM {{coarse_rate}} AS c JOIN {{decay_points}} AS d ON d.ticker_i = c.ticker_i AND d.ticker_j = c.ticker_j) AS h"""
TEXTS["fine_rate"] = f"""
SELECT t.ticker_i, t.ticker_j, rate, {_SSE} AS sse, sum(dcor * dcor) - sum(dcor) * sum(dcor) / count(*) AS total, count(*) AS n
FROM {{decay}} AS t JOIN {{best_rate}} AS b ON b.ticker_i = t.ticker_i AND b.ticker_j = t.ticker_j GROUP BY 1, 2, 3"""
TEXTS["half_lives"] = """
SELECT ticker_i, ticker_j, CASE WHEN n < 3 THEN -1 ELSE least(ln(2.0) / rate * 63, 252) END AS half_life, CASE WHEN n < 3 THEN 0 WHEN total > 1e-12 THEN 1 - sse / total ELSE 0 END AS half_life_r2 FROM {fine_rate}"""
TEXTS["stable"] = """
SELECT w.ticker_i, w.ticker_j, avg(dcor) AS mean_dcor, var_pop(dcor) AS variance_dcor, count(DISTINCT win) / (SELECT count(*) FROM {windows}) AS frequency, any_value(m.lag) AS best_lag, avg(sharpness) AS sharpness,
 count(DISTINCT win) AS n_windows_observed, any_value(half_life) AS half_life, any_value(half_life_r2) AS half_life_r2
FROM {sig} AS w JOIN (SELECT ticker_i, ticker_j, lag, row_number() OVER (PARTITION BY ticker_i, ticker_j ORDER BY count(*) DESC, lag) AS k FROM {sig} GROUP BY ticker_i, ticker_j, lag) AS m ON m.ticker_i = w.ticker_i AND m.ticker_j = w.ticker_j AND k = 1
JOIN {half_lives} AS h ON h.ticker_i = w.ticker_i AND h.ticker_j = w.ticker_j GROUP BY w.ticker_i, w.ticker_j"""
MADE["stable"] = lambda t: st.stability(t("sig"), t("windows"))

add("half_life", "ticker_i ticker_j half_life:d half_life_r2:d half_life_stable", lambda t: st.half_life(t("sig")), "SELECT *, half_life_r2 >= 0.30 AND half_life > 0 AS half_life_stable FROM {half_lives}")
add("stability_metrics", "ticker_i ticker_j mean_dcor:d variance_dcor:d frequency:d best_lag sharpness:d n_windows_observed half_life:d half_life_r2:d", lambda t: t("stable"), "SELECT * FROM {stable}")
add("stability_x_sharpness", "win ticker_i ticker_j lag dcor:d sharpness:d", lambda t: t("sig"), "SELECT * FROM {sig}")


# Out of sample: strategy, distance correlation, regression of the score.

TEXTS["strategy"] = """
SELECT ticker_i, ticker_j, date, lag, signal, position, position * y AS gross, position * y - 0.001 * abs(position) AS net FROM (
 SELECT *, (CASE WHEN direction < 0 THEN -1 ELSE 1 END) * (CASE WHEN signal > 1 THEN 1 WHEN signal < -1 THEN -1 ELSE 0 END) AS position FROM (
  SELECT *, CASE lag WHEN 1 THEN lag(z, 1) OVER v WHEN 2 THEN lag(z, 2) OVER v WHEN 3 THEN lag(z, 3) OVER v END AS signal FROM (
   SELECT *, CASE WHEN count(x) OVER w = 26 AND stddev_pop(x) OVER w > 1e-10 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w END AS z FROM (
    SELECT p.ticker_i, p.ticker_j, best_lag AS lag, oos_sharpe_net AS direction, date, x, y FROM {net} AS p JOIN {aligned} AS a ON a.ticker_i = p.ticker_i AND a.ticker_j = p.ticker_j WHERE n >= 26 + best_lag + 10) AS j
   WINDOW w AS (PARTITION BY ticker_i, ticker_j ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)) AS z1 WINDOW v AS (PARTITION BY ticker_i, ticker_j ORDER BY date)) AS s WHERE signal IS NOT NULL) AS g"""


def traded(t):
    pairs = t("net").select(*PAIR, F.col("best_lag").alias("lag"), F.col("oos_sharpe_net").alias("direction"))
    return t("returns"), t("returns"), pairs, 26


def strategy(t):
    return st.strategy_returns(*traded(t))


MADE["strategy"] = strategy
TEXTS["sharpes"] = """
SELECT ticker_i, ticker_j, CASE WHEN stddev_pop(gross) > 1e-10 THEN avg(gross) / stddev_pop(gross) * sqrt(252) END AS sharpe_gross,
 CASE WHEN stddev_pop(net) > 1e-10 THEN avg(net) / stddev_pop(net) * sqrt(252) END AS sharpe_net, count(*) AS n_days, min(lag) AS best_lag FROM {strategy} GROUP BY 1, 2 HAVING count(*) >= 30"""
MADE["sharpes"] = lambda t: st.strategy_sharpes(*traded(t))
add("strategy_returns", "ticker_i ticker_j date lag signal:d position gross:d net:d", strategy, "SELECT * FROM {strategy}")
add("global_sharpe", "ticker_i ticker_j sharpe_gross:d sharpe_net:d n_days best_lag", lambda t: t("sharpes"), "SELECT * FROM {sharpes}")

TEXTS["daily_returns"] = "SELECT * FROM (SELECT ticker, date, ln(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0)) AS log_return FROM {market_daily}) AS d WHERE log_return IS NOT NULL"
MADE["daily_returns"] = lambda t: sc.log_return(t("market_daily")).where("log_return is not null").select("ticker", "date", "log_return")
TEXTS["oos_rows"] = """
SELECT w.window_start, w.win, oos_start, ticker, date, log_return FROM {daily_returns} JOIN (SELECT *, window_end + 1 AS oos_start, window_end + 63 AS oos_end FROM {windows}) AS w ON date BETWEEN oos_start - 120 AND oos_end"""
MADE["oos_rows"] = lambda t: st.oos_slice(t("daily_returns"), cal.oos_windows(t("windows")), lookback=60)
add("oos_slice", "win ticker date in_slice log_return:d", lambda t: t("oos_rows").withColumn("in_slice", F.col("date") >= F.col("oos_start")), "SELECT *, date >= oos_start AS in_slice FROM {oos_rows}")
TEXTS["oos_aligned"] = """
SELECT s.window_start, s.win, s.ticker_i, s.ticker_j, s.lag, a.log_return AS x, b.log_return AS y, row_number() OVER (PARTITION BY s.win, s.ticker_i, s.ticker_j ORDER BY a.date) AS pos, count(*) OVER (PARTITION BY s.win, s.ticker_i, s.ticker_j) AS n
FROM {sig} AS s JOIN {oos_rows} AS a ON a.win = s.win AND a.ticker = s.ticker_i AND a.date >= a.oos_start JOIN {oos_rows} AS b ON b.win = s.win AND b.ticker = s.ticker_j AND b.date = a.date"""
TEXTS["oos_lagged"] = """
SELECT p.window_start, p.win, p.ticker_i, p.ticker_j, p.lag, p.pos, p.x, q.y FROM {oos_aligned} AS p JOIN {oos_aligned} AS q ON p.win = q.win AND p.ticker_i = q.ticker_i AND p.ticker_j = q.ticker_j AND q.pos = p.pos + p.lag WHERE p.n >= 20 AND p.n > p.lag + 4"""
TEXTS["oos_profile"] = dcor_sql("oos_lagged")
TEXTS["oos_dcors"] = "SELECT ticker_i, ticker_j, avg(dcor) AS oos_dcor, count(*) AS n_windows FROM {oos_profile} GROUP BY 1, 2"


def oos_dcor(t):
    """Mean distance correlation on the out-of-sample slices of the windows where a pair was significant."""
    slices = pr.series_arrays(t("oos_rows").where("date >= oos_start"), keys=["win"])
    asked = t("sig").select("win", *PAIR, "lag")
    return pr.dcor_lag(pr.paired(slices, asked)).groupBy(*PAIR).agg(F.avg("dcor").alias("oos_dcor"), F.count(F.lit(1)).alias("n_windows"))


MADE["oos_dcors"] = oos_dcor
add("oos_dcor", "ticker_i ticker_j oos_dcor:d n_windows", lambda t: t("oos_dcors"), "SELECT * FROM {oos_dcors}")

FEATURES = ["mean_dcor", "variance_dcor", "frequency", "half_life", "sharpness"]
TEXTS["score_rows"] = "SELECT s.ticker_i, s.ticker_j, 1 AS g, sharpe_net AS y, s.mean_dcor, s.variance_dcor, s.frequency, n.half_life, s.sharpness FROM {stable} AS s JOIN {sharpes} AS o ON o.ticker_i = s.ticker_i AND o.ticker_j = s.ticker_j JOIN {net} AS n ON n.ticker_i = s.ticker_i AND n.ticker_j = s.ticker_j WHERE n.half_life > 0 AND sharpe_net IS NOT NULL"
# the network's half-life: that of noise is capped for almost all pairs, and would have no weight of its own
MADE["score_rows"] = lambda t: t("stable").drop("half_life").join(t("net").select(*PAIR, "half_life"), PAIR).join(t("sharpes").select(*PAIR, F.col("sharpe_net").alias("y")), PAIR).where("half_life > 0 and y is not null").select(*PAIR, "y", *FEATURES)


def partialled(base: str, y: str, xs: list[str], part: str) -> str:
    """base with each of xs partialled out of those after it and of y, one after another: what is
    left of y are the residuals of its regression on xs."""
    sql, todo = base, [*xs]
    while todo:
        x = todo.pop(0)
        cols = [f"{c} - regr_slope({c}, {x}) OVER (PARTITION BY {part}) * {x} - regr_intercept({c}, {x}) OVER (PARTITION BY {part}) AS {c}" for c in (*todo, y)]
        sql = f"SELECT * REPLACE ({', '.join(cols)}) FROM ({sql}) AS f_{x}"
    return sql


def moments_sql(rows: str, part: str) -> str:
    """The sums of products that a regression of y on the features needs, a row a part."""
    terms = ["1e0", *FEATURES]
    sums = [f"sum({a} * {b}) AS a{i}_{j}" for i, a in enumerate(terms) for j, b in enumerate(terms)] + [f"sum({a} * y) AS b{i}" for i, a in enumerate(terms)] + [f"sum({a} * y) AS xy{i}" for i, a in enumerate(terms)]
    return f"SELECT {part}, count(*) AS n, sum(y * y) AS yy, {', '.join(sums)} FROM {rows} GROUP BY {part}"


def solved_sql(moments: str, part: str) -> str:
    """The regression of each part by Gauss-Jordan elimination, a subquery a step: columns b0, b1, ..."""
    k, sql = len(FEATURES) + 1, moments
    for p in range(k):
        cols = [f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" if i != p else f"a{p}_{j} / a{p}_{p} AS a{p}_{j}" for i in range(k) for j in range(p + 1, k)]
        cols += [f"b{i} - a{i}_{p} * b{p} / a{p}_{p} AS b{i}" if i != p else f"b{p} / a{p}_{p} AS b{p}" for i in range(k)]
        sql = f"SELECT {part}, n, yy, {', '.join(f'xy{i}' for i in range(k))}, {', '.join(cols)} FROM ({sql}) AS s{p}"
    return sql


def weights_sql(table: str, part: str) -> str:
    return " UNION ALL ".join(f"SELECT {part}, '{x}' AS feature, b{i} AS weight FROM {table}" for i, x in enumerate(["intercept", *FEATURES]))


TEXTS["score_solved"] = solved_sql(moments_sql("{score_rows}", "g"), "g")
_left = "(yy - (" + " + ".join(f"b{i} * xy{i}" for i in range(len(FEATURES) + 1)) + "))"
TEXTS["score_fit"] = f"SELECT n, 1 - {_left} / (yy - xy0 * xy0 / n) AS r2, (yy - xy0 * xy0 / n - {_left}) / {len(FEATURES)} / ({_left} / (n - {len(FEATURES) + 1})) AS f FROM {{score_solved}}"
TEXTS["score_weights"] = weights_sql("{score_solved}", "g")
add("score_regression", "feature weight:d r2:d f:d n", lambda t: st.score_regression(t("score_rows"), "y", FEATURES), "SELECT feature, weight, r2, f, n FROM {score_weights}, {score_fit}")
RESAMPLES = 1000
TEXTS["resampled"] = f"""
SELECT b, r.* EXCLUDE (g, i) FROM (SELECT b, CAST(1 + floor((('0x' || substr(md5(concat_ws('/', '0', b, k)), 1, 8))::BIGINT / 4294967296.0) * (SELECT count(*) FROM {{score_rows}})) AS BIGINT) AS i
 FROM (SELECT unnest(range(1, {RESAMPLES + 1})) AS b) AS bs JOIN (SELECT row_number() OVER () AS k FROM {{score_rows}}) AS ks ON true) AS d
JOIN (SELECT *, row_number() OVER (ORDER BY ticker_i, ticker_j) AS i FROM {{score_rows}}) AS r ON r.i = d.i"""
TEXTS["boot_solved"] = solved_sql(moments_sql("{resampled}", "b"), "b")
TEXTS["boot_weights"] = weights_sql("{boot_solved}", "b")
TEXTS["boot_ci"] = "SELECT feature, avg(weight) AS mean, stddev_samp(weight) AS std, quantile_cont(weight, 0.025) AS ci_lower, quantile_cont(weight, 0.975) AS ci_upper FROM {boot_weights} GROUP BY feature"
MADE["boot_ci"] = lambda t: st.bootstrap_ci(t("score_rows"), "y", FEATURES, RESAMPLES, PAIR)
add("bootstrap_ci", "feature mean:d std:d ci_lower:d ci_upper:d", lambda t: t("boot_ci"), "SELECT * FROM {boot_ci}")
add("feature_importance", "feature weight:d ci_lower:d ci_upper:d", lambda t: st.feature_importance(st.score_regression(t("score_rows"), "y", FEATURES), t("boot_ci")), """
SELECT w.feature, round(weight + 1e-9, 4) AS weight, round(ci_lower + 1e-9, 4) AS ci_lower, round(ci_upper + 1e-9, 4) AS ci_upper FROM {score_weights} AS w JOIN {boot_ci} AS c ON c.feature = w.feature WHERE w.feature <> 'intercept'""")


# What finalising puts together.

TEXTS["final"] = """
SELECT s.*, sharpe_net, oos_dcor, coalesce(i.sector, 'Unknown') AS sector_i, coalesce(j.sector, 'Unknown') AS sector_j, ci.centrality AS centrality_i, cj.centrality AS centrality_j
FROM {stable} AS s LEFT JOIN {sharpes} AS g ON g.ticker_i = s.ticker_i AND g.ticker_j = s.ticker_j LEFT JOIN {oos_dcors} AS o ON o.ticker_i = s.ticker_i AND o.ticker_j = s.ticker_j
LEFT JOIN {ticker_metadata} AS i ON i.ticker = s.ticker_i LEFT JOIN {ticker_metadata} AS j ON j.ticker = s.ticker_j LEFT JOIN {centrals} AS ci ON ci.ticker = s.ticker_i LEFT JOIN {centrals} AS cj ON cj.ticker = s.ticker_j"""


def final(t):
    out = t("stable").join(t("sharpes").select(*PAIR, "sharpe_net"), PAIR, "left").join(t("oos_dcors").select(*PAIR, "oos_dcor"), PAIR, "left")
    for x in "ij":
        out = out.join(t("ticker_metadata").select(F.col("ticker").alias(f"ticker_{x}"), F.coalesce("sector", F.lit("Unknown")).alias(f"sector_{x}")), f"ticker_{x}", "left")
        out = out.join(t("centrals").select(F.col("ticker").alias(f"ticker_{x}"), F.col("centrality").alias(f"centrality_{x}")), f"ticker_{x}", "left")
    return out


add("final_assembly", "ticker_i ticker_j mean_dcor:d half_life:d sharpe_net:d oos_dcor:d sector_i sector_j centrality_i:d centrality_j:d", final, "SELECT * FROM {final}")
