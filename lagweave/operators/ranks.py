"""Ranks over a whole table without a task that sees all of it: rows are dealt out by ranges of the
order and ranked within one; the ranges' row counts, a row a range, give the offsets."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import staged

PART = "__part"


def ranged(df: DataFrame, order: list[Column], by: list[str] = []) -> DataFrame:  # noqa: B006
    """df with its range's number, the rows in ranges before (__before) and all rows (__total), both of
    its own group of `by`, which order then begins with. Equal keys are in one range. Staged, as
    ranges are found by sampling and must not change between the count and the ranking."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")
    own = W.partitionBy(*by)  # of a row a range and group
    before = own.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, PART).agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__total", F.sum("__n").over(own))
    named = offsets.select(F.col(PART).alias("__at"), "__before", "__total", *[F.col(c).alias(f"__by_{c}") for c in by])
    same = F.col(PART) == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(named, same).drop("__at", *[f"__by_{c}" for c in by])


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with its row number, from 1, in a total order."""
    at = F.row_number().over(W.partitionBy(PART).orderBy(*order)) + F.col("__before")
    return ranged(df, order).withColumn(name, at.cast("long")).drop(PART, "__before", "__total")


def average_ranked(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """df with the rank of a value, ties at their average; null for rows without one."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    part = W.partitionBy(PART)
    rank = F.rank().over(part.orderBy(order)) + F.col("__before") + (F.count(F.lit(1)).over(W.partitionBy(PART, value)) - 1) / 2
    some = ranged(df.where(F.col(value).isNotNull()), [order]).withColumn(name, rank.cast("double")).drop(PART, "__before", "__total")
    return some.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))


def average_rank_pct(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """df with the average-rank percentile (0 to 1) of a value among the rows that have one."""
    total = df.agg(F.count(value).alias("__total"))
    return average_ranked(df, value, name, descending).join(F.broadcast(total)).withColumn(name, F.col(name) / F.col("__total")).drop("__total")  # one row
