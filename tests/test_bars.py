"""Price bars against plain loops, and that no table which grows is sent to the driver for them."""

import datetime
import random
import statistics

from lagweave.operators import windows
from lagweave.plans import surrogates


def test_bars_are_those_of_loops(spark):
    draw = random.Random(4)
    day = datetime.date(2001, 1, 1)
    rows = [(f"t{draw.randrange(3)}", day + datetime.timedelta(draw.randrange(4)), draw.choice([10.0, 12.5, 900.0, 0.25, 0.0, -3.0, draw.uniform(1, 2000)]), float(draw.randrange(1, 9)), draw.randrange(10) / 100) for _ in range(700)]
    rows += [("same", day, 7.0, 2.0, 0.0)] * 50 + [("one", day, 5.0, 4.0, 0.5), ("two", day, 1.0, 1.0, 0.0), ("two", day, 2.0, 1.0, 0.0), (None, day, 3.0, 1.0, 0.0)]
    got = {(r.ticker, r.date): r for r in windows.bars(spark.createDataFrame(rows, "ticker string, date date, price double, quantity double, discount double"), ["ticker", "date"]).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r[2:])
    assert got.keys() == groups.keys()
    for k, g in groups.items():
        unit = [p / q for p, q, _ in g]
        close = sum(p for p, *_ in g) / sum(q for _, q, _ in g)
        want = (statistics.median(unit), max(unit), min(unit), close, close * (1 - statistics.fmean(d for *_, d in g)), sum(q for _, q, _ in g))
        assert all(abs(a - b) < 2e-6 for a, b in zip(got[k][2:], want)), k


def test_parts_are_not_broadcast(spark, monkeypatch):
    plans = []
    keep = surrogates.staged
    monkeypatch.setattr(surrogates, "staged", lambda df, name, *rest, **more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name, *rest, **more))
    surrogates._made.clear()
    surrogates.get(spark, "/root/testdata/sf0.001", "market_data")
    surrogates._made.clear()
    assert plans and not any("BroadcastHashJoin" in p and "p_partkey" in p for p in plans)


def test_only_the_middle_of_a_group_is_sorted(spark):
    """The plan sorts items of the steps that hold the middle ranks, and adds the others up."""
    df = spark.range(1000).selectExpr("'a' AS ticker", "date'2001-01-01' AS date", "cast(pow(2, id % 10) AS double) AS price", "1D AS quantity", "0D AS discount")
    plan = windows.bars(df, ["ticker", "date"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number") > 0 and "step" in plan[plan.index("row_number") :]
    assert windows.bars(df, ["ticker", "date"]).first().open == (16 + 32) / 2
