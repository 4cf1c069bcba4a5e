"""Tables that change by commits: readers, dead writers, two writers, what is rewritten and read."""

import pytest
from pyspark.sql import functions as F

from lagweave.sources.snapshots import SnapshotTable
from lagweave.streaming.jobs import scratch


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "ticker string, d int, v double").select("ticker", F.date_add(F.lit("2024-01-01").cast("date"), "d").alias("date"), "v")


def seen(df):
    return sorted((r.ticker, r.date.day, r.v) for r in df.collect())


@pytest.fixture
def table(spark):
    first = rows_of(spark, [(f"t{k}", d, float(k)) for k in range(20) for d in (0, 1)])
    return SnapshotTable.create(first, scratch(spark, "snap"), "pmod(xxhash64(ticker), 8)", "ticker", "date")


def test_merge_rewrites_one_bucket(spark, table):
    before = table.manifest()
    table.merge(rows_of(spark, [("t3", 0, 99.0), ("t3", 5, 7.0)]), ["ticker", "date"])
    after = table.manifest()
    changed = [b for b in after.parts if after.parts[b] != before.parts[b]]
    assert len(changed) == 1 and after.version == before.version + 1
    assert len(spark.read.parquet(f"{table.path}/{after.parts[changed[0]][0]}").inputFiles()) == 1
    got = {(t, d): v for t, d, v in seen(table.read())}
    assert len(got) == 41 and got["t3", 1] == 99 and got["t3", 2] == 3 and got["t3", 6] == 7
    table.update(rows_of(spark, [("t4", 1, -1.0), ("no", 1, 0.0)]), ["ticker", "date"], "v")
    assert {(t, d): v for t, d, v in seen(table.read())}["t4", 2] == -1 and table.read().count() == 41
    table.delete("v > 50 or v is null")
    assert table.read().count() == 40


def test_a_dead_writer_leaves_the_old_snapshot(spark, table):
    want = seen(table.read())

    def dies(old):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        table.rewrite(dies)
    table._written(rows_of(spark, [("t1", 9, 1.0)]), table.manifest())  # killed before its manifest
    assert seen(table.read()) == want
    table.clean()
    assert seen(table.read()) == want and len([n for n in table._folders(table.path) if n.startswith("data-")]) == 2


def test_readers_keep_their_version(spark, table):
    old = table.read()
    table.replace(rows_of(spark, []), buckets=list(table.manifest().parts))
    assert old.count() == 40 and table.read().count() == 0
    table.append(rows_of(spark, [("t1", 3, 1.0)]))
    assert table.read().count() == 1


def test_two_writers_lose_nothing(spark, table):
    """Both read version 0; the second to commit does its work again on the first one's."""
    other, met = SnapshotTable(spark, table.path), []

    def add(old):
        if not met:
            met.append(other.rewrite(lambda rows: rows.withColumn("v", F.col("v") + 100)))
        return old.withColumn("v", F.col("v") * 2)

    table.rewrite(add)
    assert sorted({v for _, _, v in seen(table.read())}) == [2.0 * (k + 100) for k in range(20)]
    # other buckets: no second run
    calls = []
    mine, theirs = (table._of(rows_of(spark, [(t, 0, 0.0)])) for t in ("t1", "t2"))
    if mine != theirs:
        def once(old):
            calls.append(1)
            if len(calls) == 1:
                other.rewrite(lambda rows: rows.where("false"), theirs)
            return old

        table.rewrite(once, mine)
        assert len(calls) == 1 and "t2" not in {t for t, _, _ in seen(table.read())}


def test_appends_at_once(spark, table, monkeypatch):
    """Another append takes the version between this one's reading and its commit."""
    other, commit, calls = SnapshotTable(spark, table.path), table._commit, []

    def late(new):
        if not calls:
            other.append(rows_of(spark, [("theirs", 1, 1.0)]))
        calls.append(commit(new))
        return calls[-1]

    monkeypatch.setattr(table, "_commit", late)
    table.append(rows_of(spark, [("mine", 1, 1.0)]))
    assert calls == [False, True] and table.manifest().version == 2
    assert {"mine", "theirs"} <= {t for t, _, _ in seen(table.read())} and table.read().count() == 42


def test_marks_without_the_table(spark, table):
    table.append_new(rows_of(spark, [("t1", 1, 5.0), ("t1", 4, 5.0), ("z", 0, 1.0)]))
    assert table.read().count() == 42
    marks = table.latest_dates()
    assert {r.ticker: r.last_date.day for r in marks.collect()} == {**{f"t{k}": 2 for k in range(20)}, "t1": 5, "z": 1}
    assert all("-marks/" in f for f in marks.inputFiles())
    with pytest.raises(FileExistsError):
        SnapshotTable.create(rows_of(spark, []), table.path, "1")
    with pytest.raises(FileNotFoundError):
        SnapshotTable(spark, f"{table.path}-none").read()
