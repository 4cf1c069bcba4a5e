"""Scans with their predicates, and table maintenance as DataFrame rewrites."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import TABLES, Table
from ..staging import removed


def log_return(prices: DataFrame, price: str = "close") -> DataFrame:
    before = F.lag(price).over(W.partitionBy("ticker").orderBy("date"))
    return prices.withColumn("log_return", F.log(F.col(price) / F.nullif(before, F.lit(0.0))))


def scan_prices(prices: DataFrame, tickers: list, start, end) -> DataFrame:
    """Positive closes of the tickers in a date range, with log returns within it."""
    some = prices.where(F.col("ticker").isin(tickers) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("close") > 0))
    return log_return(some.select("ticker", "date", "close", "volume"))


def between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows in an optionally open range; a bound that isn't given adds no predicate."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df.where(F.col(column) <= F.lit(end).cast("date")) if end is not None else df


def matching(df: DataFrame, **values) -> DataFrame:
    """Rows equal to every value that is given."""
    for c, v in values.items():
        df = df.where(F.col(c) == v) if v is not None else df
    return df


def write_table(df: DataFrame, path: str, mode: str = "append", schema=None, partition: list | None = None, cluster: list | None = None) -> None:
    """append, overwrite or errorifexists; an empty input writes nothing."""
    df = df.to(schema) if schema is not None else df
    if df.isEmpty():
        return
    if cluster:
        df = df.sortWithinPartitions(*(partition or []), *cluster)
    w = df.write.mode(mode)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def upsert_snapshot(df: DataFrame, path: str, partition: str = "as_of_date") -> None:
    """Replaces every partition that df has a value of, and no others."""
    if not df.isEmpty():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def replace_window(df: DataFrame, path: str, value, partition: str = "window_start") -> None:
    """Replaces the one partition of that value by df's rows of it; without such rows it is emptied."""
    own = df.where(F.col(partition) == F.lit(value))
    if own.isEmpty():
        removed(df.sparkSession, f"{path}/{partition}={value}")
    else:
        upsert_snapshot(own, path, partition)


def create_tables(spark: SparkSession, tables: dict[str, Table] = TABLES, database: str = "default") -> None:
    """Creates the tables that aren't there, partitioned as declared."""
    for name, table in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({table.columns}) USING parquet" + (f" PARTITIONED BY ({table.partition})" if table.partition else ""))


def insert_rows(df: DataFrame, name: str, database: str = "default", tables: dict[str, Table] = TABLES) -> None:
    """Appends df to a declared table: its columns by name, missing ones null, sorted by the table's
    cluster columns within partitions."""
    spark, table = df.sparkSession, tables[name]
    schema = spark.table(f"{database}.{name}").schema
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    sort = [c for c in (table.partition, *table.cluster) if c]
    rows = df.select(*cols)
    (rows.sortWithinPartitions(*sort) if sort else rows).write.mode("append").insertInto(f"{database}.{name}")


def merge_rows(target: DataFrame, staging: DataFrame, keys: list) -> DataFrame:
    """Update all, insert missing: staging's row where there is one, else the target's."""
    return target.join(staging.select(*keys), keys, "left_anti").unionByName(staging.select(*target.columns))


def keyed_update(target: DataFrame, staging: DataFrame, keys: list, column: str) -> DataFrame:
    """Sets column from staging where the keys match; a null there overwrites too."""
    s = staging.select(*keys, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    return target.join(s, keys, "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).select(*target.columns)


def flip_current(weights: DataFrame, version=None) -> DataFrame:
    return weights.withColumn("is_current", F.lit(False) if version is None else F.col("model_version") == version)


def older_than(years: int, today, date: str = "date") -> str:
    """The condition of rows that pruning takes out."""
    return f"{date} < date_sub(cast('{today}' AS date), {years * 365})"


def prune_old(df: DataFrame, years: int, today, date: str = "date") -> DataFrame:
    return df.where(F.col(date) >= F.date_sub(F.lit(today).cast("date"), years * 365))


def prune_stale_keys(df: DataFrame, seen: DataFrame, today, days: int = 45, key: str = "ticker") -> DataFrame:
    """df without the keys whose newest row in `seen` is older than that."""
    stale = seen.groupBy(key).agg(F.max("date").alias("last")).where(F.col("last") < F.date_sub(F.lit(today).cast("date"), days))
    return df.join(stale, key, "left_anti")


def latest_date_per_key(df: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    return df.groupBy(key).agg(F.max(date).alias("last_date"))


def newer_rows(incoming: DataFrame, marks: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Incoming rows newer than their key's last_date in marks; all rows of unknown keys."""
    return incoming.join(marks, key, "left").where(F.col("last_date").isNull() | (F.col(date) > F.col("last_date"))).select(*incoming.columns)


def incremental_append(stored: DataFrame, incoming: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Incoming rows newer than each key's newest stored row; all rows of unknown keys. A stored table of
    snapshots.py has marks that save reading it."""
    return newer_rows(incoming, latest_date_per_key(stored, key, date), key, date)


def key_gap(target: DataFrame, existing: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, side): keys missing from existing, and keys only there."""
    t, e = target.select(key).distinct(), existing.select(key).distinct()
    return t.join(e, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(e.join(t, key, "left_anti").withColumn("side", F.lit("extra")))


def top_n_universe(weighted: DataFrame, fallback_a: DataFrame, fallback_b: DataFrame, n: int, accept: float = 0.9) -> DataFrame:
    """The n heaviest tickers; with fewer than accept * n of them, all of a and the heaviest 1000
    of b. The choice is a scalar subquery in the plan, no driver decision."""
    best = weighted.orderBy(F.desc("weight"), "ticker").limit(n).select("ticker")
    size = best.agg((F.count(F.lit(1)) >= accept * n).alias("__enough"))
    other = fallback_a.select("ticker").union(fallback_b.orderBy(F.desc("weight"), "ticker").limit(1000).select("ticker")).distinct()
    both = best.withColumn("__first", F.lit(True)).unionByName(other.withColumn("__first", F.lit(False)))
    return both.join(F.broadcast(size), F.col("__first") == F.col("__enough")).select("ticker")


def wide_to_long(wide: DataFrame, keys: list, fields: list) -> DataFrame:
    """field_ticker columns to rows (keys, ticker, fields); rows without close go, a null volume is 0."""
    names = [c for c in wide.columns if c not in keys]
    long = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "name", "value")
    split = long.withColumn("field", F.substring_index("name", "_", 1)).withColumn("ticker", F.expr("substring(name, length(field) + 2)"))
    out = split.groupBy(*keys, "ticker").pivot("field", fields).agg(F.first("value"))
    return out.where("close is not null").withColumn("volume", F.coalesce(F.col("volume"), F.lit(0.0)).cast("long"))


def symbol_remap(df: DataFrame, names: DataFrame, cutoff) -> DataFrame:
    """Vendor symbols renamed by names(vendor, symbol), rows newer than the cutoff only."""
    newer = df.where(F.col("date") > F.lit(cutoff).cast("date"))
    return newer.join(names, F.col("ticker") == F.col("vendor"), "left").withColumn("ticker", F.coalesce("symbol", "ticker")).drop("vendor", "symbol")


def ohlcv_range(tables: list[DataFrame], reference, days: int) -> DataFrame:
    """Rows of the last days (4, 7, 30, ...) up to the reference date from several tables, once per
    ticker and date: the first table that has it wins; source is that table's number."""
    inside = F.col("date").between(F.date_sub(F.lit(reference).cast("date"), days), F.lit(reference).cast("date"))
    every = reduce(DataFrame.unionByName, [t.where(inside).withColumn("source", F.lit(i)) for i, t in enumerate(tables)])
    rest = [c for c in every.columns if c not in ("ticker", "date")]
    return every.groupBy("ticker", "date").agg(F.min_by(F.struct(*rest), "source").alias("r")).select("ticker", "date", "r.*")


def append_run(log: DataFrame, path: str) -> None:
    """Adds records to the run log."""
    write_table(log, path, "append", partition=["run_date"])


def latest_run(log: DataFrame) -> DataFrame:
    return log.where("status = 'COMPLETE'").orderBy(F.desc("run_date"), "run_id").limit(1)


def factor_text(lines: DataFrame) -> DataFrame:
    """(date, mkt_rf, smb, hml, rmw, cma, rf) of text lines `value`: those that begin with an
    eight-digit date of 19xx or 20xx, five or seven fields, percent to decimal."""
    parts = F.split("value", r"\s*,\s*")
    rows = lines.where(F.col("value").rlike(r"^\s*(19|20)\d{6}\s*,")).select(parts.alias("p"), F.size(parts).alias("n"))
    number = lambda i: F.try_divide(F.expr(f"try_cast(trim(p[{i}]) as double)"), F.lit(100.0))
    return rows.where("n in (5, 7)").select(
        F.to_date(F.trim(F.col("p")[0]), "yyyyMMdd").alias("date"), number(1).alias("mkt_rf"), number(2).alias("smb"), number(3).alias("hml"),
        F.when(F.col("n") == 7, number(4)).alias("rmw"), F.when(F.col("n") == 7, number(5)).alias("cma"), F.when(F.col("n") == 7, number(6)).otherwise(number(4)).alias("rf"),
    )


def clean_symbol(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), r"\.", "-")


#: As many columns of a holdings file are read.
HOLDINGS_COLUMNS = 24


def holdings_text(files: DataFrame) -> DataFrame:
    """(file, ticker, weight_pct) of fund-holdings files (file, text): what stands before the header,
    the first line with "Ticker" and "Weight" or "Name", is skipped; fields may be quoted and come in
    any order. Equities only where there is an asset class; listed symbols only, the first row of
    each; without a weight column all weigh 1, unreadable weights are 0."""
    schema, column = ", ".join(f"c{i} string" for i in range(HOLDINGS_COLUMNS)), F.col
    fields = lambda c: F.array(*[c[f"c{i}"] for i in range(HOLDINGS_COLUMNS)])
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "value")).withColumn("csv", F.from_csv("value", schema, {"escape": '"'}))
    header = column("value").contains("Ticker") & (column("value").contains("Weight") | column("value").contains("Name"))
    heads = lines.where(header).groupBy("file").agg(F.min(F.struct("pos", "csv")).alias("h"))
    heads = heads.select("file", column("h.pos").alias("head"), F.transform(fields(column("h.csv")), lambda x: F.lower(F.trim(x))).alias("names"))
    rows = lines.join(heads, "file").where((column("pos") > column("head")) & (F.trim("value") != "")).withColumn("f", fields(column("csv")))
    at = lambda test: F.coalesce(F.array_position(F.transform("names", test), True), F.lit(0))
    field = lambda test: F.when(at(test) > 0, F.trim(F.get("f", (at(test) - 1).cast("int"))))
    kind, weight = field(lambda x: x == "asset class"), field(lambda x: x.contains("weight"))
    number = F.coalesce(F.regexp_replace(weight, ",", "").try_cast("double"), F.lit(0.0))
    rows = rows.select("file", "pos", clean_symbol(field(lambda x: x == "ticker")).alias("ticker"), F.when(at(lambda x: x == "asset class") > 0, F.coalesce(kind == "Equity", F.lit(False))).otherwise(True).alias("equity"), F.when(at(lambda x: x.contains("weight")) > 0, number).otherwise(1.0).alias("weight"))
    good = rows.where(column("equity") & column("ticker").rlike("^[A-Z]{1,5}(-[A-Z])?$"))
    return good.groupBy("file", "ticker").agg(F.min_by("weight", "pos").alias("weight_pct"))


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a folder as (file, text); a file is as long as a fund has holdings."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return factor_text(spark.read.text(path))
