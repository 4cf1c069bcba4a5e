"""Streaming queries: their results equal the batch form."""

from pyspark.sql import functions as F

from ..streaming import jobs
from .book import Book

book = Book()
add = book.add


def prices(t):
    spark, folder = t.spark, jobs.scratch(t.spark, "prices")
    bars = t("market_data").select("ticker", "date", "close")
    bars.where("date >= date '2000-01-01'").write.parquet(f"{folder}/in")
    source = spark.readStream.schema(bars.schema).parquet(f"{folder}/in")
    stored = bars.where("date < date '2001-01-01' and ticker != 'Brand#5'")
    return jobs.stream_prices(spark, source, stored, f"{folder}/table", f"{folder}/state")


add("stream_prices", "ticker date close:d log_return:d", prices, """
SELECT ticker, date, close, ln(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0)) AS log_return FROM {market_data} WHERE ticker <> 'Brand#5' OR date >= DATE '2000-01-01'""")


def latest(t):
    spark, folder = t.spark, jobs.scratch(t.spark, "latest")
    bars = t("market_data").select("ticker", "date", "close")
    bars.where("date >= date '2001-07-01'").write.parquet(f"{folder}/in")
    source = spark.readStream.schema(bars.schema).parquet(f"{folder}/in")
    mean = lambda rows: rows.groupBy("window_start", "ticker").agg(F.avg("close").alias("close"))
    return jobs.stream_latest_window(spark, source, mean, bars.where("date < date '2001-07-01'"), f"{folder}/table", f"{folder}/state")


add("stream_latest_window", "window_start ticker close:d", latest, "SELECT CAST(date_trunc('quarter', date) AS DATE) AS window_start, ticker, avg(close) AS close FROM {market_data} WHERE date >= DATE '2001-07-01' GROUP BY 1, 2")


def clicks(t):
    spark, folder = t.spark, jobs.scratch(t.spark, "clicks")
    source = spark.readStream.schema(t("events").schema).parquet(f"{t.sf_dir}/events.parquet*")
    clicked = source.where("event_type = 'click'").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.stream_clicks(spark, clicked, f"{folder}/out", f"{folder}/state").withColumn("window_start", F.to_date("window_start"))


add("stream_clicks", "window_start user_id event_type n", clicks, "SELECT CAST(ts AS DATE) AS window_start, user_id, event_type, count(*) AS n FROM {events} WHERE event_type = 'click' GROUP BY 1, 2, 3")
