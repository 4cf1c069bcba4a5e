"""Rolling windows as a small generated table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rolling_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(window_start, window_end): a year from each quarter on, as far as the end date."""
    starts = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 3 months"))).alias("window_start"))
    return starts.withColumn("window_end", F.date_sub(F.add_months("window_start", 12), 1)).where(F.col("window_end") <= F.lit(end).cast("date"))


def quarters(rows: DataFrame) -> DataFrame:
    """(window_start, window_end): a year from each quarter on in which rows has dates."""
    starts = rows.select(F.to_date(F.date_trunc("quarter", "date")).alias("window_start")).distinct()
    return starts.withColumn("window_end", F.date_sub(F.add_months("window_start", 12), 1))


def oos_windows(windows: DataFrame, days: int = 63) -> DataFrame:
    return windows.withColumn("oos_start", F.date_add("window_end", 1)).withColumn("oos_end", F.date_add("window_end", days))


def latest_window(windows: DataFrame) -> DataFrame:
    return windows.orderBy(F.desc("window_start")).limit(1)
