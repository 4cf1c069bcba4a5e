"""Streams that read no history: late and repeated rows, and what a batch reads."""

import datetime
import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from lagweave.streaming import jobs

DAY = "2024-01-01"


def bars(spark, rows):
    return spark.createDataFrame(rows, "ticker string, d int, close double").select("ticker", F.date_add(F.lit(DAY).cast("date"), F.col("d")).alias("date"), "close")


def files(spark, where, batches):
    for i, rows in enumerate(batches):
        bars(spark, rows).coalesce(1).write.mode("append").parquet(str(where))
        time.sleep(1.1)
    return spark.readStream.schema(bars(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(where))


def test_prices_late_repeated_and_bounded(spark, tmp_path):
    batches = [[("a", 5, 10.0), ("a", 6, 11.0)], [("a", 6, 11.0), ("a", 3, 1.0), ("b", 2, 4.0)], [("b", 4, 8.0), ("a", 7, 22.0)], [("c", 9, 1.0)], [("a", 2, 5.0)]]
    source = files(spark, tmp_path / "in", batches)
    path = jobs.scratch(spark, "p")
    got = jobs.stream_prices(spark, source, bars(spark, [("a", 4, 5.0)]), path, f"{path}-state")
    rows = {(r.ticker, (r.date - datetime.date(2024, 1, 1)).days): r.log_return for r in got.collect()}
    assert rows.keys() == {("a", 4), ("a", 5), ("a", 6), ("a", 7), ("b", 2), ("b", 4), ("c", 9)} and got.count() == 7
    assert {k for k, x in rows.items() if x is None} == {("a", 4), ("b", 2), ("c", 9)}
    assert all(abs(rows[k] - 0.6931471805599453) < 1e-12 for k in (("a", 5), ("a", 7), ("b", 4)))
    folders = sorted(os.listdir(Path(path.removeprefix("file:")) / "marks"), key=int)
    assert len(folders) <= 2 and int(folders[-1]) >= 4
    assert spark.read.parquet(f"{path}/marks/{folders[-1]}").count() == 3


def test_windows_read_their_own_partitions(spark, tmp_path, monkeypatch):
    stored = bars(spark, [("a", 0, 1.0), ("a", 100, 3.0), ("a", 200, 9.0)])  # three quarters
    source = files(spark, tmp_path / "in", [[("a", 101, 5.0)], [("a", 1, 2.0), ("b", 300, 7.0)], [("a", 101, 50.0)]])
    path, read = jobs.scratch(spark, "w"), []

    def mean(rows):
        read.append({str(r[0]) for r in rows.select("window_start").distinct().collect()})
        pruned = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in pruned and "window_start" in pruned.split("PartitionFilters: [")[1].split("]")[0]
        return rows.groupBy("window_start", "ticker").agg(F.avg("close").alias("close"), F.count(F.lit(1)).alias("n"))

    got = jobs.stream_latest_window(spark, source, mean, stored, path, f"{path}-state")
    assert {(str(r.window_start), r.ticker): (r.close, r.n) for r in got.collect()} == {("2024-04-01", "a"): (26.5, 2), ("2024-01-01", "a"): (1.5, 2), ("2024-10-01", "b"): (7.0, 1)}
    assert read == [{"2024-04-01"}, {"2024-01-01", "2024-10-01"}, {"2024-04-01"}]
