"""Window-function operators on price-like series, rankings and top-k."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import staged
from ..workers import prepared
from . import ranks
from .stats import average_rank_pct

#: Stands for a missing target in arrays of doubles.
NO_TARGET = -1.7976931348623157e308


def by_date():
    return W.partitionBy("ticker").orderBy("date")


def _step(x: Column) -> Column:
    """A whole number that never falls where x grows: half a doubling of x apart."""
    up = lambda v: F.floor(F.log2(v) * 2)  # noqa: E731  within 3,000 of 0
    return F.when(F.isnan(x), 300_000).when(F.abs(x) == float("inf"), F.when(x > 0, 200_000).otherwise(-300_000)).when(x > 0, up(x)).when(x == 0, -100_000).when(x < 0, -200_000 - up(-x)).cast("int")


def bars(items: DataFrame, keys: list) -> DataFrame:
    """(keys, open, high, low, close, adj_close, volume) of items(keys, price, quantity, discount): the
    median, largest and smallest unit price, the price a piece, the same after the mean discount.

    Tasks add items up by steps of the unit price before anything shuffles. The steps' counts tell
    which one or two hold the middle ranks of a group; only items in those are sorted, for the exact
    median. Items are read twice."""
    x = items.withColumn("unit", F.col("price") / F.col("quantity")).withColumn("step", _step(F.col("unit")))
    per = x.groupBy(*keys, "step").agg(
        F.count("unit").alias("n"), F.sum("price").alias("price"), F.sum("quantity").alias("quantity"), F.sum("discount").alias("discount"), F.count("discount").alias("discounts"),
        F.max("unit").alias("high"), F.min("unit").alias("low"),
    )
    per = staged(per, "steps")
    own = W.partitionBy(*keys)
    before = F.sum("n").over(own.orderBy(F.asc_nulls_last("step"))) - F.col("n")
    ranks_of = [F.floor((F.sum("n").over(own) + i) / 2) - before for i in (1, 2)]  # in the step, of the two middle items, or of one twice
    middle = per.select(*keys, "step", "n", *[r.alias(f"at{i}") for i, r in enumerate(ranks_of)]).where("at0 between 1 and n or at1 between 1 and n")
    middle = staged(middle.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("step").alias("__step"), "at0", "at1"), "middle")
    same = F.col("step") == F.col("__step")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    near = x.join(middle, same).select(*keys, "step", "unit", "at0", "at1").withColumn("k", F.row_number().over(W.partitionBy(*keys, "step").orderBy("unit")))
    halves = [F.max(F.when(F.col("k") == F.col(f"at{i}"), F.col("unit"))) for i in (0, 1)]
    medians = near.where("k = at0 or k = at1").groupBy(*keys).agg((0.5 * halves[0] + 0.5 * halves[1]).alias("middle"))
    medians = medians.select(*[F.col(c).alias(f"__{c}") for c in keys], "middle")
    total = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("price", "quantity", "discount", "discounts")], F.max("high").alias("high"), F.min("low").alias("low"))
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    tidy = lambda c: F.round(c + 1e-9, 6)
    close = F.col("price") / F.col("quantity")
    return total.join(medians, match, "left").select(
        *keys, tidy(F.col("middle")).alias("open"), tidy(F.col("high")).alias("high"), tidy(F.col("low")).alias("low"), tidy(close).alias("close"),
        tidy(close * (1 - F.try_divide("discount", "discounts"))).alias("adj_close"), F.floor(F.col("quantity") + 1e-6).cast("long").alias("volume"),
    )


def day_over_day(prices: DataFrame) -> DataFrame:
    """Latest close, the one before (default: the latest) and the change, in one pass."""
    k = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
    two = prices.withColumn("k", k).where("k <= 2")
    out = two.groupBy("ticker").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("price"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("before"), F.max(F.when(F.col("k") == 1, F.col("volume"))).alias("volume"))
    out = out.withColumn("before", F.coalesce("before", "price"))
    return out.withColumn("change_pct", F.try_divide((F.col("price") - F.col("before")) * 100, F.col("before")))


def last_n_rows(rows: DataFrame, n: int, least: int) -> DataFrame:
    w = W.partitionBy("ticker")
    some = rows.withColumn("k", F.row_number().over(w.orderBy(F.desc("date")))).where(F.col("k") <= n)
    return some.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= least).drop("__n")


def cumulative_return(rows: DataFrame, value: str) -> DataFrame:
    return rows.withColumn("cumulative", F.exp(F.sum(F.log1p(value)).over(by_date().rowsBetween(W.unboundedPreceding, 0))) - 1)


def drawdown(rows: DataFrame, value: str, keys: list, order: str) -> DataFrame:
    peak = F.max(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("drawdown", (F.col(value) - peak) / peak)


def max_drawdown(rows: DataFrame, value: str, keys: list, order: str) -> DataFrame:
    return drawdown(rows, value, keys, order).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def time_to_recovery(rows: DataFrame, value: str, keys: list, order: str) -> DataFrame:
    """Steps from the lowest value (the first one) to the first later value at or above the
    highest before it; null without recovery, or if the lowest value is the first row."""
    trough = rows.groupBy(*keys).agg(F.min_by(order, F.struct(value, order)).alias("__t"), F.min(order).alias("__first"))
    both = rows.join(trough, keys)
    peak = both.where(F.col(order) < F.col("__t")).groupBy(*keys).agg(F.max(value).alias("__peak"))
    back = both.join(peak, keys).where((F.col(order) > F.col("__t")) & (F.col(value) >= F.col("__peak"))).groupBy(*keys).agg(F.min(order).alias("__back"))
    return trough.join(back, keys, "left").select(*keys, (F.col("__back") - F.col("__t")).alias("recovery"))


def ffill(rows: DataFrame, value: str) -> DataFrame:
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(by_date().rowsBetween(W.unboundedPreceding, 0)))


def index_to_100(rows: DataFrame) -> DataFrame:
    return rows.withColumn("indexed", F.col("close") / F.first("close").over(by_date()) * 100)


def daily_pct(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pct", F.coalesce((F.col("close") / F.lag("close").over(by_date()) - 1) * 100, F.lit(0.0)))


def yoy_overlay(rows: DataFrame, years: list) -> DataFrame:
    """Each year rebased to 100, by trading-day number, a column a year."""
    w = W.partitionBy("ticker", F.year("date")).orderBy("date")
    some = rows.where(F.year("date").isin(years)).withColumn("day", F.row_number().over(w)).withColumn("v", F.col("close") / F.first("close").over(w) * 100).withColumn("y", F.concat(F.lit("y"), F.year("date").cast("string")))
    return some.groupBy("ticker", "day").pivot("y", [f"y{y}" for y in years]).agg(F.first("v"))


def cap_per_key(df: DataFrame, keys: list, order: list, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def topk_persistence(df: DataFrame, snapshot: str, member: str) -> DataFrame:
    """Jaccard overlap of each snapshot's set with the one before; an empty union gives 0."""
    sets = df.groupBy(snapshot).agg(F.collect_set(member).alias("s"))
    before = F.lag("s").over(W.orderBy(snapshot))  # a row a snapshot
    return sets.withColumn("b", before).where("b is not null").select(snapshot, F.coalesce(F.try_divide(F.size(F.array_intersect("s", "b")), F.size(F.array_union("s", "b"))), F.lit(0.0)).alias("persistence"))


def vol_fit(df: DataFrame, vol: str, target: float | DataFrame) -> DataFrame:
    """100 for the volatility nearest to the target (a number, or a one-row frame) down to 0; unknown ones 50."""
    goal = df.sparkSession.range(1).select(F.lit(target).alias("__goal")) if not isinstance(target, DataFrame) else target.toDF("__goal")
    gap = df.where(F.col(vol).isNotNull()).join(F.broadcast(goal)).withColumn("__gap", F.abs(F.col(vol) - F.col("__goal"))).drop("__goal")
    total = gap.agg(F.count(F.lit(1)).alias("__n"))
    near = ranks.numbered(gap, [F.col("__gap"), F.col("ticker")], "__r").join(F.broadcast(total))  # one row
    near = near.withColumn("vol_fit", (1 - (F.col("__r") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))) * 100).drop("__gap", "__r", "__n")
    return near.unionByName(df.where(F.col(vol).isNull()).withColumn("vol_fit", F.lit(50.0)))


def minmax_rank(df: DataFrame, metrics: dict[str, tuple[float, bool]]) -> DataFrame:
    """Weighted score over min-max scaled metrics, higher_is_better by metric; weights are shared
    out again over the metrics a row has, a flat metric scores 0.5; then rank, unscored last."""
    ends = df.agg(*[f(m).alias(f"__{m}_{f.__name__}") for m in metrics for f in (F.min, F.max)])
    out = df.join(F.broadcast(ends))
    total, weight = F.lit(0.0), F.lit(0.0)
    for m, (w, higher) in metrics.items():
        lo, hi = F.col(f"__{m}_min"), F.col(f"__{m}_max")
        x = F.when(hi == lo, 0.5).otherwise((F.col(m) - lo) / (hi - lo))
        x = x if higher else F.when(hi == lo, 0.5).otherwise(1 - (F.col(m) - lo) / (hi - lo))
        total += F.when(F.col(m).isNotNull(), x * w).otherwise(0.0)
        weight += F.when(F.col(m).isNotNull(), w).otherwise(0.0)
    out = out.withColumn("score", F.try_divide(total, F.nullif(weight, F.lit(0.0))))
    return ranks.numbered(out.drop(*[c for c in out.columns if c.startswith("__")]), [F.col("score").desc_nulls_last(), F.col("ticker")])


def fundamental_score(meta: DataFrame) -> DataFrame:
    """Half P/E score (rank within the sector, low is good, capped at 100, missing: the sector's
    median, none: 50) and half market-cap score."""
    pe = meta.withColumn("pe", F.when(F.col("pe_ratio") > 0, F.least(F.col("pe_ratio"), F.lit(100.0))))
    pe = pe.withColumn("s", average_rank_pct("pe", ["sector"], descending=True) * 100)
    mid = pe.where("sector is not null").groupBy("sector").agg(F.percentile("s", 0.5).alias("mid"))
    every = pe.agg(F.percentile("s", 0.5).alias("mid_all"))
    joined = ranks.average_rank_pct(pe.join(mid, "sector", "left").join(F.broadcast(every)), "market_cap", "__cap")
    pe_score = F.coalesce("s", F.when(F.col("sector").isNull(), F.col("mid_all")).otherwise(F.coalesce("mid", F.lit(50.0))))
    return joined.withColumn("fundamental", F.round(0.5 * pe_score + 0.5 * F.col("__cap") * 100 + 1e-9, 2))


def cross_sectional_ic(df: DataFrame, pred: str, target: str) -> DataFrame:
    """Mean over dates of the rank correlation, ties at their average rank."""
    rank = lambda c: F.rank().over(W.partitionBy("date").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("date", c)) - 1) / 2
    r = df.withColumn("__p", rank(pred)).withColumn("__t", rank(target))
    return r.groupBy("date").agg(F.corr("__p", "__t").alias("ic")).agg(F.avg("ic").alias("ic"), F.count("ic").alias("days"))


def long_short(df: DataFrame, pred: str, target: str, share: float, periods: int = 252) -> DataFrame:
    """Daily (mean of the best k - mean of the worst k) / 2."""
    n = F.count(F.lit(1)).over(W.partitionBy("date"))
    k = F.greatest(F.lit(1), F.floor(n * share))
    up, down = (F.row_number().over(W.partitionBy("date").orderBy(o, "ticker")) for o in (F.desc(pred), F.asc(pred)))
    day = df.withColumn("u", up <= k).withColumn("d", down <= k).groupBy("date").agg(((F.avg(F.when(F.col("u"), F.col(target))) - F.avg(F.when(F.col("d"), F.col(target)))) / 2).alias("r"))
    return day.agg((F.avg("r") * periods).alias("annual_return"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("daily_sharpe"))


def concordant_pairs(p: np.ndarray, t: np.ndarray) -> int:
    """Pairs with p and t both larger in one row than in the other, in O(n log n) for n rows: rows in
    the order of p (within ties of p by falling t, which counts none of them) are merged by t. A
    merge is a pass over the bits of t's rank from the highest: among rows that share the bits so
    far, in order, each with the bit set has all earlier ones without it below it."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    rank, total = rank[np.lexsort((-rank, p))], 0
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        rank = rank[np.argsort(rank >> (bit + 1), kind="stable")]
        high, up = rank >> (bit + 1), (rank >> bit) & 1
        zeros = np.cumsum(1 - up)
        head = np.ones(len(rank), bool)
        head[1:] = high[1:] != high[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(rank)), 0))
        before = zeros[first] - (1 - up[first])  # zeros ahead of the row's group
        total += int(((zeros - before) * up).sum())
    return total


def _ordered_pairs(p: np.ndarray) -> int:
    n, ties = len(p), np.unique(p, return_counts=True)[1].astype(object)
    return n * (n - 1) // 2 - int((ties * (ties - 1) // 2).sum()) if n else 0


def ordered_pair_accuracy(df: DataFrame, pred: str, target: str, tail: int | None = None) -> DataFrame:
    """Share of a date's pairs that are ordered by pred as by target; with tail, pairs of the best
    with the worst `tail` by pred only. Pairs that tie by pred don't count, and those without a target
    only as pairs. A date's rows are two arrays in one task, where pairs are counted by merging."""
    rows = df.select("date", "ticker", F.col(pred).cast("double").alias("p"), F.col(target).cast("double").alias("t"))
    if tail:
        up = F.row_number().over(W.partitionBy("date").orderBy(F.desc("p"), "ticker"))
        down = F.row_number().over(W.partitionBy("date").orderBy("p", F.desc("ticker")))
        rows = rows.withColumn("u", up).withColumn("d", down)
        a, b = rows.where(F.col("u") <= tail), rows.where(F.col("d") <= tail)
        pairs = a.alias("a").join(b.alias("b"), (F.col("a.date") == F.col("b.date")) & ((F.col("a.p") > F.col("b.p"))))
        return pairs.agg(F.avg((F.col("a.t") > F.col("b.t")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("pairs"))

    def count(batches):
        for batch in batches:
            got = []
            for p, t in zip(batch.column("p"), batch.column("t")):
                p, t = np.asarray(p.values), np.asarray(t.values)
                known = t != NO_TARGET
                got.append((_ordered_pairs(p), _ordered_pairs(p[known]), concordant_pairs(p[known], t[known])))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(3)], ["pairs", "judged", "right"])

    prepared(df.sparkSession)
    point = F.struct("p", F.coalesce("t", F.lit(NO_TARGET)).alias("t"))
    dates = rows.where("date is not null and p is not null").groupBy("date").agg(F.collect_list(point).alias("s"))
    counts = dates.select(F.col("s.p").alias("p"), F.col("s.t").alias("t")).mapInArrow(count, "pairs long, judged long, right long")
    return counts.agg(F.try_divide(F.sum("right"), F.sum("judged")).alias("accuracy"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"))


def lag_entropy(df: DataFrame, lag: str) -> DataFrame:
    n = df.groupBy(lag).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("total")
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).agg(F.sum(-p * F.log(p)).alias("entropy"), F.count(F.lit(1)).alias("lags"))
