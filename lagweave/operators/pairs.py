"""Pairs of series: generation, alignment, lagged dependence, permutation tests.

A series is one row: its keys, its days and its values as arrays in order of days. Its length is
bounded by a window's. Pairs join two such rows, so what shuffles is a row per pair and window and
not one per date; alignment and lags happen on the arrays inside Arrow batches. Every operator
takes rows of `paired` and keeps the keys it finds there (window_start, if series had it).
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import staged
from ..workers import prepared
from .ranks import PART, ranged

ENDS = ["ticker_i", "ticker_j"]
ARRAYS = ["xd", "xv", "yd", "yv"]


def all_pairs(tickers: DataFrame, direction: str = "canonical") -> DataFrame:
    """Every unordered pair, the smaller ticker first; with direction 'both', each order."""
    a, b = (tickers.select(F.col("ticker").alias(f"ticker_{x}")) for x in "ij")
    return a.join(b, F.col("ticker_i") < F.col("ticker_j") if direction == "canonical" else F.col("ticker_i") != F.col("ticker_j"))


def sector_pairs(meta: DataFrame) -> DataFrame:
    """Pairs within a sector that is known and not blank: an equi-join on the sector."""
    known = meta.where("trim(sector) != ''").select("ticker", "sector")
    a, b = (known.select(F.col("ticker").alias(f"ticker_{x}"), "sector") for x in "ij")
    return a.join(b, "sector").where("ticker_i < ticker_j")


def series_arrays(series: DataFrame, value: str = "log_return", keys=()) -> DataFrame:
    """(keys, ticker, d, v): a row per series, its days as numbers and its values in order."""
    some = series.where(F.col(value).isNotNull())
    point = F.struct(F.unix_date("date").alias("d"), F.col(value).cast("double").alias("v"))
    s = some.groupBy(*keys, "ticker").agg(F.array_sort(F.collect_list(point)).alias("s"))
    return s.select(*keys, "ticker", F.col("s.d").alias("d"), F.col("s.v").alias("v"))


def paired(arrays: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with both ends' series. Keys that pairs has as well (window_start) must agree."""
    keys = [c for c in arrays.columns if c not in ("ticker", "d", "v")]
    x, y = (arrays.select(*keys, F.col("ticker").alias(f"ticker_{e}"), F.col("d").alias(f"{n}d"), F.col("v").alias(f"{n}v")) for e, n in (("i", "x"), ("j", "y")))
    return pairs.join(x, ["ticker_i", *(k for k in keys if k in pairs.columns)]).join(y, ["ticker_j", *keys])


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """A list column as one array a row, cut from its flat buffer."""
    col = batch.column(name)
    at = np.asarray(col.offsets)
    return np.split(np.asarray(col.values)[at[0] : at[-1]], at[1:-1] - at[0]) if len(col) else []


def common_days(batch: pa.RecordBatch, min_obs: int):
    """(row, days, x, y) of each row's common days, if there are min_obs."""
    for i, (xd, xv, yd, yv) in enumerate(zip(*(_lists(batch, c) for c in ARRAYS))):
        days, a, b = np.intersect1d(xd, yd, assume_unique=True, return_indices=True)
        if len(days) >= min_obs:
            yield i, days, xv[a], yv[b]


def _lagged(batch: pa.RecordBatch, min_obs: int, guard: int, lags=None):
    """(row, lag, x, y with y `lag` positions later) for every lag, or each row's own, that leaves
    more than guard rows."""
    own = batch.column("lag").to_pylist() if lags is None else None
    for i, _, x, y in common_days(batch, min_obs):
        for lag in lags if own is None else [own[i]]:
            if len(x) > lag + guard:
                yield i, lag, x[: len(x) - lag], y[lag:]


def _keys(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ARRAYS]


def mapped(rows: DataFrame, run, extra: str, keep: list[str] | None = None) -> DataFrame:
    """rows through run(batch, take), where take(row numbers, columns) makes a batch with the keys."""
    prepared(rows.sparkSession)
    keep = _keys(rows) if keep is None else keep
    names = [x.split()[0] for x in extra.split(", ")]

    def each(batches):
        for batch in batches:
            of, cols = run(batch)
            if len(of):
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(c).take(of) for c in keep] + [pa.array(c) if not isinstance(c, pa.Array) else c for c in cols], [*keep, *names])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(each, f"{schema}, {extra}")


def _flat(parts: list, kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


def aligned(rows: DataFrame, min_obs: int = 20) -> DataFrame:
    """(keys, date, x, y, pos, n): both series on their common dates, at least min_obs, numbered."""

    def run(batch):
        got = list(common_days(batch, min_obs))
        n = [len(d) for _, d, _, _ in got]
        return np.repeat([i for i, *_ in got], n) if got else [], [pa.array(_flat([d for _, d, _, _ in got], np.int32)).cast(pa.date32()), _flat([x for *_, x, _ in got], float), _flat([y for *_, y in got], float), _flat([np.arange(1, k + 1) for k in n], np.int32), np.repeat(np.array(n, np.int64), n)]

    return mapped(rows, run, "date date, x double, y double, pos int, n long")


def lagged(rows: DataFrame, lags, min_obs: int = 20, guard: int = 4) -> DataFrame:
    """(keys, lag, pos, x, y): each aligned x with the y `lag` positions later."""

    def run(batch):
        got = list(_lagged(batch, min_obs, guard, lags))
        n = [len(x) for _, _, x, _ in got]
        return np.repeat([g[0] for g in got], n) if got else [], [np.repeat(np.array([g[1] for g in got], np.int32), n), _flat([np.arange(1, k + 1) for k in n], np.int32), _flat([g[2] for g in got], float), _flat([g[3] for g in got], float)]

    return mapped(rows, run, "lag int, pos int, x double, y double")


def _row_means(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean distance of each value to all values, by sorting: O(n log n) and no matrix."""
    n, order = len(x), np.argsort(x, kind="stable")
    s = x[order]
    c = np.cumsum(s)
    k = np.arange(n)
    out = np.empty(n)
    out[order] = ((k + 1) * s - c + (c[-1] - c) - (n - 1 - k) * s) / n
    return out, float(out.mean())


class Distances:
    """What distance covariance needs of two series: dCov² = mean(a·b) - 2 mean(ā·b̄) + mean(a) mean(b).
    Only the first term needs all distances; the squares' mean is twice the variance."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.n = x, y, len(x)
        (self.ax, self.mx), (self.ay, self.my) = _row_means(x), _row_means(y)
        vx, vy = (2 * float(v.var()) - 2 * float((m * m).mean()) + u * u for v, m, u in ((x, self.ax, self.mx), (y, self.ay, self.my)))
        self.scale = float(np.sqrt(vx * vy)) if vx > 1e-14 and vy > 1e-14 else 0.0

    def _cross(self, order: np.ndarray, kind=float) -> np.ndarray:
        """Sum of |x_i - x_j| |y_i - y_j| over i < j, x in each of the orders (a row each): distances are
        taken between positions d apart, for all orders side by side, so nothing has n² elements."""
        x, y = np.ascontiguousarray(self.x[order].T, kind), self.y.astype(kind)
        total, room = np.zeros(len(order), kind), np.empty_like(x)
        for d in range(1, self.n):
            gap = np.subtract(x[d:], x[: self.n - d], out=room[: self.n - d])
            np.abs(gap, out=gap)
            total += np.abs(y[d:] - y[: self.n - d]) @ gap
        return total

    def _ratio(self, cross: np.ndarray, order: np.ndarray) -> np.ndarray:
        return (2 * cross / self.n**2 - 2 * (self.ax[order] @ self.ay) / self.n + self.mx * self.my) / self.scale

    def ratios(self, order: np.ndarray) -> np.ndarray:
        """dCov² over its scale for x in each of the orders."""
        return self._ratio(self._cross(order), order)

    def reach(self, order: np.ndarray, least: float) -> int:
        """How many orders' ratios are `least` or more: in single precision first, and again in double
        for those that its rounding (n roundings of each sum at most) leaves open."""
        cross = self._cross(order, np.float32).astype(float)
        ratio = self._ratio(cross, order)
        slack = 4 * self.n * float(np.finfo(np.float32).eps) * 2 * cross / self.n**2 / self.scale
        near = np.flatnonzero(np.abs(ratio - least) <= slack)
        if len(near):
            ratio[near] = self.ratios(order[near])
        return int((ratio >= least).sum())

    def correlation(self) -> float:
        return float(np.sqrt(min(1.0, max(0.0, float(self.ratios(np.arange(self.n)[None])[0]))))) if self.scale else 0.0


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    return Distances(x, y).correlation() if len(x) >= 4 else 0.0


def _pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    sx, sy = float(x.std()), float(y.std())
    return None if sx < 1e-10 or sy < 1e-10 else float(((x - x.mean()) * (y - y.mean())).mean() / (sx * sy))


def pearson_lag(rows: DataFrame, lags, min_obs: int = 20) -> DataFrame:
    """(keys, lag, obs, pearson): signed correlation at each lag; null where a side hardly varies."""

    def run(batch):
        got = [(i, lag, len(x), _pearson(x, y)) for i, lag, x, y in _lagged(batch, min_obs, 4, lags)]
        return [g[0] for g in got], [pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.float64())]

    return mapped(rows, run, "lag int, obs long, pearson double")


def dcor_lag(rows: DataFrame, lags=None, min_obs: int = 20) -> DataFrame:
    """(keys, lag, obs, dcor) at each lag, or at each row's own lag if lags aren't given."""

    def run(batch):
        got = [(i, lag, len(x), distance_correlation(x, y)) for i, lag, x, y in _lagged(batch, min_obs, 4, lags)]
        return [g[0] for g in got], [pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.float64())]

    return mapped(rows, run, "lag int, obs long, dcor double", [c for c in _keys(rows) if c != "lag"])


def sharpness(profile: DataFrame, keys: list, form: str = "entropy") -> DataFrame:
    """How concentrated the positive dCor values of a lag profile are: 1 - H / ln K, or max / sum;
    none gives 0, one gives 1."""
    d = F.when(F.col("dcor") > 0, F.col("dcor"))
    total, k = F.sum(d), F.count(d)
    entropy = F.log(total) - F.try_divide(F.sum(d * F.log(d)), total)
    value = 1 - F.try_divide(entropy, F.log(k.cast("double"))) if form == "entropy" else F.try_divide(F.max(d), total)
    return profile.groupBy(*keys).agg(F.when(k == 0, 0.0).when(k == 1, 1.0).otherwise(value).alias("sharpness"))


def best_lag(profile: DataFrame, keys: list, value: str = "dcor") -> DataFrame:
    """The lag with the greatest value, the smallest on ties."""
    best = F.max_by(F.struct("lag", value), F.struct(F.round(value, 9), -F.col("lag")))
    return profile.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.lag").alias("best_lag"), F.col(f"b.{value}").alias(value))


def block_orders(name: str, n: int, first: int, count: int, block: int = 5) -> np.ndarray:
    """Orders of positions 0..n-1, a row each: blocks of `block` positions (the last may be short) in
    the order of keyed hashes of (name, permutation, block). The same come out anywhere."""
    blocks = -(-n // block)
    seed = np.uint64(int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "little"))
    place = (np.arange(first, first + count, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(blocks, dtype=np.uint64)
    key = seed ^ (place * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
    order = np.argsort(key ^ (key >> np.uint64(31)), axis=1, kind="stable")
    at = (order[:, :, None] * block + np.arange(block)).reshape(count, -1)
    return at[at < n].reshape(count, n)


#: Orders of positions that are looked at side by side.
ORDERS = 256


def _hits(x: np.ndarray, y: np.ndarray, name: str, first: int, count: int) -> int:
    """How many of `count` permutations from `first` on reach the observed value, 1 at most and 0 at
    least. Scales don't matter to it, so both series are brought to about 1."""
    d = Distances(*((v - v.mean()) / (v.std() or 1.0) for v in (x, y)))
    observed = min(1.0, max(0.0, float(d.ratios(np.arange(d.n)[None])[0])))
    if observed <= 1e-12:
        return count
    return sum(d.reach(block_orders(name, d.n, k, min(ORDERS, first + count - k)), observed - 1e-12) for k in range(first, first + count, ORDERS))


def bh_threshold(tested: DataFrame, by: list, alpha: float) -> DataFrame:
    """(by, threshold): the largest p of tested(by, p) that Benjamini-Hochberg lets pass, null if none.
    Equal p-values are counted first; permutations give as many different ones as they are at most."""
    counts = tested.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(*by).orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    m = F.sum("n").over(W.partitionBy(*by))
    passes = F.col("p") * m / F.sum("n").over(upto) <= alpha * (1 + 1e-9)
    return counts.withColumn("t", F.when(passes, F.col("p"))).groupBy(*by).agg(F.max("t").alias("threshold"))


def permutation_p(rows: DataFrame, lags, tiers=((100, 0.20), (500, 0.10), (1000, None)), floor: float = 0.05, seed: int = 7, min_obs: int = 20, alpha: float | None = None) -> DataFrame:
    """(keys, lag, dcor, p_value, permutations), staged. Pair-lags under the floor get p = 1 with no
    permutation. Each tier tops up to its count those that the tier before let through; they are
    staged, dealt out again before every tier, and permuted inside the kernel, a row a pair-lag.

    With alpha, only what FDR control will look at is tested: of each pair the lag with the largest
    dCor over 0 (the smallest lag on ties). After a tier, each pair that goes on could still end at
    (hits + 1) / (last count + 1); with these best cases and the final p-values of the others,
    Benjamini-Hochberg gives each window the highest threshold that it can still reach, and a pair
    whose best case is over it stops. Thresholds only fall from there, and a stopped pair's p is over
    its best case, so bh_fdr at alpha finds the same pairs significant as without such stops."""
    keys = [*_keys(rows), "lag"]
    by = [k for k in keys if k not in (*ENDS, "lag")]
    spark = rows.sparkSession

    def observe(batch):
        got = [(i, lag, distance_correlation(x, y), x, y) for i, lag, x, y in _lagged(batch, min_obs, 4, lags)]
        if alpha is not None:
            best = {}
            for g in got:
                if g[2] > 0 and (g[0] not in best or round(g[2], 9) > round(best[g[0]][2], 9)):
                    best[g[0]] = g
            got = list(best.values())
        listed = lambda k: pa.array([g[k] for g in got], pa.list_(pa.float64()))
        return [g[0] for g in got], [pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.float64()), listed(3), listed(4)]

    def permute(first: int, count: int):
        def run(batch):
            names = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            more = [_hits(x, y, "/".join(map(str, (seed, *name))), first, count) for name, x, y in zip(names, _lists(batch, "x"), _lists(batch, "y"))]
            return np.arange(len(more)), [pa.array(np.asarray(batch.column("hits")) + np.array(more, np.int64))]

        return run

    observed = staged(mapped(rows, observe, "lag int, dcor double, x array<double>, y array<double>", [k for k in keys if k != "lag"]), "observed")
    out = observed.where(F.col("dcor") < floor).select(*keys, "dcor", F.lit(1.0).alias("p_value"), F.lit(0).alias("permutations"))
    left, done, spent = observed.where(F.col("dcor") >= floor).withColumn("hits", F.lit(0).cast("long")), 0, [observed]
    for count, stop in tiers:
        carried = [*keys, "dcor", "x", "y"]
        tried = staged(mapped(left.repartition(*keys), permute(done, count - done), "hits long", carried), f"tier{count}")
        spent.append(tried)
        p = (F.col("hits") + 1) / (F.lit(float(count)) + 1)
        over = F.lit(True) if count == tiers[-1][0] else p > stop if stop is not None else F.lit(False)
        if alpha is not None and count != tiers[-1][0]:
            best = (F.col("hits") + 1) / (F.lit(float(tiers[-1][0])) + 1)
            known = out.select(*by, F.col("p_value").alias("p")).unionByName(tried.select(*by, F.when(over, p).otherwise(best).alias("p")))
            limit = staged(bh_threshold(known.withColumn("__all", F.lit(1)), [*by, "__all"], alpha), "thresholds", rows=1)
            tried = tried.withColumn("__all", F.lit(1)).join(limit, [*by, "__all"], "left").drop("__all")
            over = over | (best > F.coalesce("threshold", F.lit(0.0)))
            spent.append(limit)
        out = out.unionByName(tried.where(over).select(*keys, "dcor", p.alias("p_value"), F.lit(count).alias("permutations")))
        left, done = tried.where(~over).select(*carried, "hits"), count
    return staged(out, "tested", spent=tuple(spent))


def pair_panel(rows: DataFrame, lags, **options) -> DataFrame:
    """(keys, lag, dcor, p_value, permutations, sharpness, pearson) of every pair and lag."""
    keys = _keys(rows)
    tested = permutation_p(rows, lags, **options)
    return tested.join(pearson_lag(rows, lags).drop("obs"), [*keys, "lag"]).join(sharpness(tested.select(*keys, "dcor"), keys), keys)


def tier_budget(results: DataFrame, last: int = 1000, alert: float = 0.10) -> DataFrame:
    """Share of pair-lags that reached the last tier, and whether that is too many."""
    share = F.avg((F.col("permutations") >= last).cast("double"))
    return results.agg(share.alias("tier3_fraction"), (share > alert).alias("alert"))


def bh_fdr(results: DataFrame, alpha: float = 0.05, partition: str = "window_start", choose: str | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values within each window: the running minimum of p * m / rank from
    the largest p down. With `choose`, each pair first keeps its lag with the greatest such value
    over 0, the smallest lag on ties.

    Rows are dealt out by ranges of (window, p), so one window can fill all tasks. Rows of a window in
    earlier ranges are added to a row's rank, and the least value of later ranges bounds its minimum;
    both come from tables with a row a range and window."""
    keys = [partition, *ENDS]
    if choose:
        best = F.max_by(F.struct(*[c for c in results.columns if c not in keys]), F.struct(F.round(choose, 9), -F.col("lag")))
        results = results.where(F.col(choose) > 0).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
    order = [F.col(c) for c in ("p_value", "ticker_i", "ticker_j", "lag")]
    rows = ranged(results, [F.col(partition), *order], [partition])
    part = W.partitionBy(partition, PART)
    ranked = rows.withColumn("__raw", F.col("p_value") * F.col("__total") / (F.row_number().over(part.orderBy(*order)) + F.col("__before")))
    later = W.partitionBy(partition).orderBy(F.desc(PART)).rowsBetween(W.unboundedPreceding, -1)
    least = ranked.groupBy(partition, PART).agg(F.min("__raw").alias("__least")).withColumn("__later", F.min("__least").over(later))
    least = least.select(F.col(partition).alias("__of"), F.col(PART).alias("__at"), "__later")
    both = ranked.join(least, F.col(partition).eqNullSafe(F.col("__of")) & (F.col(PART) == F.col("__at")))
    own = F.min("__raw").over(part.orderBy(*order).rowsBetween(0, W.unboundedFollowing))
    q = F.least(F.lit(1.0), own, "__later")
    return both.withColumn("q_value", q).withColumn("significant", F.col("q_value") <= alpha).select(*results.columns, "q_value", "significant")


def direction_counts(results: DataFrame, value: str = "pearson") -> DataFrame:
    return results.agg(F.count_if(F.col(value) > 0).alias("positive"), F.count_if(F.col(value) < 0).alias("negative"), F.count_if(F.col(value).isNull()).alias("unknown"))


def correlation_matrix(rows: DataFrame) -> DataFrame:
    """(ticker_i, ticker_j, corr) over common dates: each pair once from its arrays, then both
    orders and the diagonal."""
    half = pearson_lag(rows, (0,), min_obs=2).where("obs > 4").select(*ENDS, F.col("pearson").alias("corr"))
    swapped = half.select(F.col("ticker_j").alias("ticker_i"), F.col("ticker_i").alias("ticker_j"), "corr")
    ends = half.select("ticker_i").union(half.select("ticker_j")).distinct()
    return half.unionByName(swapped).unionByName(ends.select("ticker_i", F.col("ticker_i").alias("ticker_j"), F.lit(1.0).alias("corr")))


def lead_lag_beta(rows: DataFrame, lags, min_obs: int = 30) -> DataFrame:
    """(keys, lag, corr, beta, obs): best lag by absolute correlation, and the slope of the follower
    on the lagged leader there."""

    def run(batch):
        got = []
        for i, lag, x, y in _lagged(batch, min_obs, 4, lags):
            if len(x) >= min_obs and (r := _pearson(x, y)) is not None:
                got.append((i, lag, r, r * float(y.std()) / float(x.std()), len(x)))
        return [g[0] for g in got], [pa.array([g[k] for g in got], t) for k, t in ((1, pa.int32()), (2, pa.float64()), (3, pa.float64()), (4, pa.int64()))]

    per, keys = mapped(rows, run, "lag int, corr double, beta double, obs long"), _keys(rows)
    return per.groupBy(*keys).agg(F.max_by(F.struct("lag", "corr", "beta", "obs"), F.struct(F.round(F.abs("corr"), 9), -F.col("lag"))).alias("b")).select(*keys, "b.*")
