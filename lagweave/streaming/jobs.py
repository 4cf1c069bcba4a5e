"""Structured Streaming forms of the time-driven work. All run to the end of what is there
(availableNow) and continue from their checkpoint the next time."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import removed
from ..workers import shared_dir


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def run(stream: DataFrame, checkpoint: str, each_batch=None, path: str | None = None, mode: str = "append") -> None:
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(each_batch) if each_batch else w.format("parquet").option("path", path)).start()
    q.awaitTermination()


def high_water(rows: DataFrame) -> DataFrame:
    """(ticker, last_date, last_close): each ticker's newest row."""
    return rows.groupBy("ticker").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))


def with_return(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows newer than their ticker's mark, with log returns: the first one's is against the mark's
    close, so that no batch begins with a null."""
    new = rows.join(marks, "ticker", "left").where(F.col("last_date").isNull() | (F.col("date") > F.col("last_date")))
    before = F.coalesce(F.lag("close").over(W.partitionBy("ticker").orderBy("date")), F.col("last_close"))
    return new.withColumn("log_return", F.log(F.col("close") / F.nullif(before, F.lit(0.0)))).select(*rows.columns, "log_return")


MARKS = "ticker string, last_date date, last_close double"


def stream_prices(spark: SparkSession, source: DataFrame, stored: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Price rows (ticker, date, close, ...) appended beyond each ticker's newest stored date, once
    each, with log returns; late and repeated ones are left out. Beside the table, which is partitioned
    by year and batch, each batch leaves the marks of all tickers, a row each with the newest date and
    close. The next one reads that one folder alone, and older ones are deleted, so what a batch reads
    follows the tickers and not the history. A batch run again reads the same marks and writes the
    same rows in the same place."""
    none = stored.select("ticker", F.lit(None).cast("date").alias("last_date"), F.lit(None).cast("double").alias("last_close")).distinct()
    first = with_return(stored, none)
    first.withColumn("year", F.year("date")).withColumn("batch", F.lit(-1)).write.mode("overwrite").partitionBy("year", "batch").parquet(f"{path}/rows")
    high_water(stored).write.mode("overwrite").parquet(f"{path}/marks/-1")
    once = source.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["ticker", "date"]).drop("ts")

    def append(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        marks = session.read.schema(MARKS).parquet(f"{path}/marks/{number - 1}")
        new = with_return(batch, marks).persist()
        new.withColumn("year", F.year("date")).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "batch").parquet(f"{path}/rows")
        both = marks.unionByName(high_water(new))
        newest = both.groupBy("ticker").agg(F.max_by(F.struct("last_date", "last_close"), "last_date").alias("m")).select("ticker", "m.*")
        newest.write.mode("overwrite").parquet(f"{path}/marks/{number}")
        new.unpersist()
        removed(session, f"{path}/marks/{number - 2}")

    run(once, checkpoint, append)
    return spark.read.parquet(f"{path}/rows").drop("year", "batch")


def stream_latest_window(spark: SparkSession, source: DataFrame, compute, stored: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """compute(rows) -> rows with window_start, for the windows that a batch touches only; their
    partitions are replaced. Rows are kept in a table with a partition a window and batch, first those
    of stored, so a batch reads the partitions of its own windows and nothing else. Of rows that
    repeat a ticker and date, late ones too, that of the newest batch counts. Returns the windows
    that batches have touched."""
    window = F.to_date(F.date_trunc("quarter", "date"))
    rows_at, out_at = f"{path}/rows", f"{path}/windows"

    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("window_start", window).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_start", "batch").parquet(rows_at)

    keep(stored, -1)

    def refresh(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        touched = [r[0] for r in batch.select(window.alias("w")).where("w is not null").distinct().collect()]  # quarters of a batch
        keep(batch, number)
        if touched:
            known = session.read.schema(f"{kind}, window_start date, batch int").parquet(rows_at)
            now = known.where(F.col("window_start").isin(touched) & (F.col("batch") <= number))
            columns = [c for c in now.columns if c not in ("ticker", "date", "batch")]
            newest = now.groupBy("ticker", "date").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("ticker", "date", "r.*")
            compute(newest).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_start").parquet(out_at)

    kind = ", ".join(f"`{c}` {t}" for c, t in stored.dtypes)
    run(source, checkpoint, refresh)
    return spark.read.parquet(out_at)


def click_counts(events: DataFrame, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """Counts by user and type in tumbling windows; rows later than the watermark are dropped, and so
    is the state of windows that it has passed."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "user_id", "event_type", "n")


def stream_clicks(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, **options) -> DataFrame:
    """click_counts in update mode: a batch writes the counts that it changed under its number, and
    of each key the newest one holds."""
    changed = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    run(click_counts(events, **options), checkpoint, changed, mode="update")
    return spark.read.parquet(path).groupBy("window_start", "user_id", "event_type").agg(F.max_by("n", "batch").alias("n"))
