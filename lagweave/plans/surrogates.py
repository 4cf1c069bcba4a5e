"""Price-like tables made from the TPC-H-like ones: one SQL text for Spark and for the oracle.

{name} is a table; MEDIAN(x) is written as each engine names it. Dependent tables are common table
expressions in the oracle and DataFrames in Spark. What stands for results of the analysis (pair
panels, the scored network, scenarios) is made by this library's operators in Spark, registered in
MADE, and by SQL of its own in the oracle. So are the price bars, by the functions in BARS.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import bars
from ..staging import dropped, staged

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_BARS = """
SELECT ticker, date, round(MEDIAN(unit) + 1e-9, 6) AS open, round(max(unit) + 1e-9, 6) AS high, round(min(unit) + 1e-9, 6) AS low,
 round(sum(price) / sum(quantity) + 1e-9, 6) AS close, round(sum(price) / sum(quantity) * (1 - avg(discount)) + 1e-9, 6) AS adj_close, CAST(floor(sum(quantity) + 1e-6) AS BIGINT) AS volume
FROM (%s) AS x GROUP BY ticker, date"""

_ITEM = "l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount, l_extendedprice / l_quantity AS unit"

TEXTS = {
    "market_daily": _BARS % f"SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, {_ITEM} FROM {{lineitem}} AS l JOIN {{part}} AS p ON l_partkey = p_partkey",
    "market_data": _BARS % f"SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {_ITEM} FROM {{lineitem}} AS l JOIN {{part}} AS p ON l_partkey = p_partkey",
    "general_market_data": _BARS % f"SELECT n_name AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {_ITEM} FROM {{lineitem}} AS l JOIN {{supplier}} AS s ON l_suppkey = s_suppkey JOIN {{nation}} AS n ON s_nationkey = n_nationkey",
    "ticker_metadata": """
SELECT ticker, CASE WHEN b = 25 THEN NULL ELSE r_name END AS sector, concat(ticker, ' ', common) AS company_name, market_cap,
 CASE WHEN b % 7 = 0 THEN NULL WHEN b % 11 = 0 THEN -pe ELSE pe END AS pe_ratio
FROM (SELECT p_brand AS ticker, CAST(substr(p_brand, 7) AS INT) AS b, CAST(floor(sum(p_retailprice * p_size) + 1e-6) AS BIGINT) AS market_cap, round(avg(p_retailprice) / avg(p_size) + 1e-9, 6) AS pe FROM {part} GROUP BY p_brand) AS g
JOIN (SELECT brand, min(p_type) AS common FROM (SELECT p_brand AS brand, p_type, rank() OVER (PARTITION BY p_brand ORDER BY count(*) DESC) AS k FROM {part} GROUP BY p_brand, p_type) AS c WHERE k = 1 GROUP BY brand) AS m ON m.brand = g.ticker
JOIN {region} AS r ON r_regionkey = (b - 1) % 5""",
    "returns": """
SELECT ticker, date, ln(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0)) AS log_return, close, volume,
 CAST(row_number() OVER (PARTITION BY ticker ORDER BY date) AS INT) AS pos FROM {market_data}""",
    "ff_factors": """
SELECT date, avg(log_return) - 1e-4 AS mkt_rf, 1e-4 AS rf,
 coalesce(avg(CASE WHEN cap_third = 1 THEN log_return END) - avg(CASE WHEN cap_third = 3 THEN log_return END), 0e0) AS smb,
 coalesce(avg(CASE WHEN pe_third = 1 THEN log_return END) - avg(CASE WHEN pe_third = 3 THEN log_return END), 0e0) AS hml
FROM {returns} AS r JOIN (SELECT ticker, ntile(3) OVER (ORDER BY market_cap, ticker) AS cap_third, ntile(3) OVER (ORDER BY coalesce(pe_ratio, 0), ticker) AS pe_third FROM {ticker_metadata}) AS t ON r.ticker = t.ticker
WHERE log_return IS NOT NULL GROUP BY date""",
    "panel": """
SELECT p.as_of_date, p.ticker_i, p.ticker_j, lag, corr(p.x, q.y) AS pearson, CAST(count(*) AS BIGINT) AS n FROM {as_of_aligned} AS p JOIN (SELECT unnest([1, 2, 3]) AS lag) AS l ON true
JOIN {as_of_aligned} AS q ON q.as_of_date = p.as_of_date AND q.ticker_i = p.ticker_i AND q.ticker_j = p.ticker_j AND q.pos = p.pos + lag
WHERE p.n >= 20 AND p.n > lag + 4 GROUP BY p.as_of_date, p.ticker_i, p.ticker_j, lag""",
    "as_of_aligned": """
SELECT as_of_date, a.ticker AS ticker_i, b.ticker AS ticker_j, a.log_return AS x, b.log_return AS y, row_number() OVER (PARTITION BY as_of_date, a.ticker, b.ticker ORDER BY a.date) AS pos, count(*) OVER (PARTITION BY as_of_date, a.ticker, b.ticker) AS n
FROM {returns} AS a JOIN {returns} AS b ON a.date = b.date AND a.ticker < b.ticker JOIN (SELECT DATE '2000-12-31' AS as_of_date UNION ALL SELECT DATE '2001-12-31') AS s ON a.date <= s.as_of_date
WHERE a.log_return IS NOT NULL AND b.log_return IS NOT NULL""",
    "edges": """
SELECT e.as_of_date, ticker_i, ticker_j, best_lag, mean_dcor, variance_dcor, frequency, half_life, sharpness, signal_strength, oos_sharpe_net, i.sector AS sector_i, j.sector AS sector_j,
 round(avg(signal_strength) OVER (PARTITION BY e.as_of_date, ticker_i) / 100 + 1e-9, 6) AS centrality_i, round(avg(signal_strength) OVER (PARTITION BY e.as_of_date, ticker_j) / 100 + 1e-9, 6) AS centrality_j
FROM (SELECT s.*, 21e0 * best_lag AS half_life, round(CASE WHEN hi > lo THEN (least(greatest(mean_dcor, lo), hi) - lo) / (hi - lo) * 100 ELSE 50 END + 1e-9, 6) AS signal_strength
 FROM {scored} AS s JOIN (SELECT as_of_date, quantile_cont(mean_dcor, 0.05) AS lo, quantile_cont(mean_dcor, 0.95) AS hi FROM {scored} GROUP BY as_of_date) AS q ON q.as_of_date = s.as_of_date) AS e
LEFT JOIN {ticker_metadata} AS i ON i.ticker = ticker_i LEFT JOIN {ticker_metadata} AS j ON j.ticker = ticker_j""",
    "scored": """
SELECT as_of_date, ticker_i, ticker_j, round(max(abs(pearson)) + 1e-9, 6) AS mean_dcor, round(var_pop(abs(pearson)) + 1e-9, 6) AS variance_dcor, round(avg(CASE WHEN abs(pearson) > 0.05 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS frequency,
 max(CASE WHEN k = 1 THEN lag END) AS best_lag, round(max(abs(pearson)) / nullif(sum(abs(pearson)), 0) + 1e-9, 6) AS sharpness, round(sum(pearson) + 1e-9, 6) AS oos_sharpe_net
FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, ticker_i, ticker_j ORDER BY round(abs(pearson), 9) DESC, lag) AS k FROM {panel}) AS p GROUP BY as_of_date, ticker_i, ticker_j""",
    "net": "SELECT * FROM {edges} WHERE as_of_date = DATE '2001-12-31'",
    "user_clicks": "SELECT user_id, concat('Brand#', CAST(1 + event_id % 25 AS VARCHAR(10))) AS symbol, ts FROM {events} WHERE event_type = 'click'",
}
TEXTS["ends"] = "SELECT ticker_i AS ticker, ticker_j AS other, true AS leads, sector_i AS sector, sector_j AS other_sector, centrality_i AS centrality, signal_strength, frequency, half_life, mean_dcor FROM {net} UNION ALL SELECT ticker_j, ticker_i, false, sector_j, sector_i, centrality_j, signal_strength, frequency, half_life, mean_dcor FROM {net}"
TEXTS["centrals"] = "SELECT ticker, max(centrality) AS centrality, min(sector) AS sector FROM {ends} GROUP BY ticker"
#: Tables that Spark makes by operators: name -> function of a function that gives tables by name.
MADE: dict = {}



def _brands(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))


def _nations(t) -> DataFrame:
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("ticker"))


def _items(t, names: DataFrame, key: str) -> DataFrame:
    """Items by name and day. Names grow with the items, so both are dealt out by key and names never go
    through the driver, small as their files are."""
    items = t("lineitem").select(key, F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return items.join(names.hint("shuffle_hash"), key).drop(key)


def _weeks(items: DataFrame) -> DataFrame:
    return items.withColumn("date", F.date_trunc("week", "date").cast("date"))


#: Items are stored once for the daily and the weekly bars, which read them twice each.
BARS = {
    "brand_items": lambda t: _items(t, _brands(t), "l_partkey"),
    "nation_items": lambda t: _items(t, _nations(t), "l_suppkey"),
    "market_daily": lambda t: bars(t("brand_items"), ["ticker", "date"]),
    "market_data": lambda t: bars(_weeks(t("brand_items")), ["ticker", "date"]),
    "general_market_data": lambda t: bars(_weeks(t("nation_items")), ["ticker", "date"]),
}

_made: dict = {}


def _uses(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or surrogate table. Surrogates are kept for the session, as many queries use them: bars and
    results of operators as staged tables, where their long plans end, the others in the cache."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        if make := BARS.get(name) or MADE.get(name):
            _made[key] = staged(make(lambda n: get(spark, sf_dir, n)), name)
            return _made[key]
        text = TEXTS[name].replace("MEDIAN(unit)", "percentile(unit, 0.5)").replace("VARCHAR(10)", "STRING")
        _made[key] = spark.sql(text, **{u: get(spark, sf_dir, u) for u in _uses(text)}).persist()
    return _made[key]


def forget() -> None:
    """Lets go of the tables that operators made, so that the next query makes them again."""
    for key in [k for k in _made if k[2] in MADE]:
        dropped(_made.pop(key))


def oracle(sql: str) -> str:
    """sql for DuckDB, where {name} is a table: with the surrogates it needs in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for u in _uses(text):
            if u in TEXTS and u not in order:
                need(TEXTS[u])
                order.append(u)

    need(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t).replace("MEDIAN(unit)", "quantile_cont(unit, 0.5)")
    made = [f"{u} AS MATERIALIZED ({plain(TEXTS[u])})" for u in order]
    return ("WITH " + ", ".join(made) + " " if made else "") + plain(sql).strip()
