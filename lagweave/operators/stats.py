"""Aggregates, factor models, strategy returns, stability, scoring."""

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import staged
from ..workers import prepared
from .pairs import ENDS, common_days, mapped, series_arrays
from .quantiles import exact_quantiles
from .ranks import average_ranked, numbered


def ticker_stats(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.percentile(F.col("close") * F.col("volume"), 0.5).alias("median_dollar_volume"))


def universe_filter(prices: DataFrame, meta: DataFrame, days: int, min_years: float, min_coverage: float, min_dollar_volume: float, min_cap: float) -> DataFrame:
    """Per ticker the first rule that it breaks, in order, or OK."""
    stats = ticker_stats(prices).join(meta.select("ticker", "market_cap"), "ticker", "left").withColumn("market_cap", F.coalesce("market_cap", F.lit(0)))
    stats = stats.withColumn("coverage", F.col("n_days") / F.lit(float(int(days * 252 / 365))))
    reason = (
        F.when(F.col("n_days") < int(min_years * 252), "insufficient_history")
        .when(F.col("coverage") < min_coverage, "low_coverage")
        .when(F.col("median_dollar_volume") < min_dollar_volume, "low_volume")
        .when(F.col("market_cap") < min_cap, "low_market_cap")
        .otherwise("OK")
    )
    return stats.withColumn("reason", reason).withColumn("is_valid", F.col("reason") == "OK")


def _solve(moments: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, their matrices X'X, X'y) from rows of the upper triangle of X'X and of X'y, all
    rows at once; rows whose matrix is singular by pseudo-inverse."""
    tri = np.triu_indices(k)
    xx = np.zeros((len(moments), k, k))
    xx[:, tri[0], tri[1]] = xx[:, tri[1], tri[0]] = moments[:, : len(tri[0])]
    xy = moments[:, len(tri[0]) : len(tri[0]) + k]
    # scaled to a diagonal of ones, so that a singular matrix shows
    d = np.sqrt(np.maximum(np.einsum("nii->ni", xx), 1e-300))
    z, target = xx / (d[:, :, None] * d[:, None, :]), (xy / d)[:, :, None]
    singular = ~(np.linalg.cond(z) < 1e10)
    out = np.empty_like(xy)
    if not singular.all():
        out[~singular] = np.linalg.solve(z[~singular], target[~singular])[:, :, 0]
    if singular.any():
        out[singular] = (np.linalg.pinv(np.nan_to_num(z[singular]), rcond=1e-10, hermitian=True) @ target[singular])[:, :, 0]
    return out / d, xx, xy


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of lists of one length as a matrix, from its flat buffer."""
    col = batch.column(name)
    at = np.asarray(col.offsets)
    return np.asarray(col.values)[at[0] : at[-1]].reshape(len(batch), -1)


def _moments(y: str, xs: list, weight: Column | None = None) -> Column:
    """Sums of products of the terms 1 and xs, of terms and y, and of y and y."""
    terms = [F.lit(1.0), *[F.col(x) for x in xs]]
    w = F.lit(1.0) if weight is None else weight
    products = [terms[i] * terms[j] for i in range(len(terms)) for j in range(i, len(terms))] + [t * F.col(y) for t in terms] + [F.col(y) * F.col(y)]
    return F.array(*[F.sum(w * p) for p in products])


def fitted(moments: DataFrame, k: int) -> DataFrame:
    """beta, r2 and f of each row of moments(..., n, m) with k terms; r2 is null if y doesn't vary,
    f as well if nothing is left over."""
    names = [c for c in moments.columns if c != "m"]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch, "m")
            beta, _, xy = _solve(m, k)
            n = np.asarray(batch.column("n")).astype(float)
            total = m[:, -1] - xy[:, 0] ** 2 / n
            left = np.maximum(m[:, -1] - (beta * xy).sum(1), 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = np.where(total > 1e-12, 1 - left / total, np.nan)
                f = (total - left) / max(k - 1, 1) / (left / (n - k))
            bad = lambda v: pa.array(v, mask=~np.isfinite(v))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(list(beta), pa.list_(pa.float64())), bad(r2), bad(f)], [*names, "beta", "r2", "f"])

    return moments.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in moments.select(*names).dtypes) + ", beta array<double>, r2 double, f double")


def ols(rows: DataFrame, keys: list, y: str, xs: list, min_obs: int) -> DataFrame:
    """(keys, n, beta array with the intercept first, r2, f) per group: one aggregation collects the
    moment sums, so no group is ever gathered; a small solve runs on the groups' moment rows."""
    prepared(rows.sparkSession)
    keyed = rows.where(F.col(y).isNotNull())
    one = keyed.withColumn("__all", F.lit(1)) if not keys else keyed
    agg = one.groupBy(*(keys or ["__all"])).agg(F.count(F.lit(1)).alias("n"), _moments(y, xs).alias("m")).where(F.col("n") >= min_obs)
    return fitted(agg, len(xs) + 1).drop("__all")


def ols_residuals(rows: DataFrame, keys: list, y: str, xs: list, min_obs: int = 60) -> DataFrame:
    beta = ols(rows, keys, y, xs, min_obs)
    fit = sum((F.col("beta")[i + 1] * F.col(x) for i, x in enumerate(xs)), F.col("beta")[0])
    return rows.where(F.col(y).isNotNull()).join(beta, keys).withColumn("residual", F.col(y) - fit).drop("beta", "n", "r2", "f")


def rolling_residuals(rows: DataFrame, windows: DataFrame, y: str, xs: list, min_obs: int = 60) -> DataFrame:
    """(window_start, win, ticker, date, residual) of an OLS of each ticker in each of windows(
    window_start, window_end, win), which begin and end with quarters. Rows are summed up once, by
    quarter: a window's moments are the sums of its quarters', and a quarter's rows get the few
    coefficients of the windows that hold it in one list, so rows shuffle once and are not copied
    before they are results."""
    prepared(rows.sparkSession)
    known = rows.where(F.col(y).isNotNull()).withColumn("pane", F.to_date(F.date_trunc("quarter", "date")))
    panes = staged(known.groupBy("ticker", "pane").agg(F.count(F.lit(1)).alias("n"), _moments(y, xs).alias("m")), "panes")
    size = (len(xs) + 1) * (len(xs) + 2) // 2 + len(xs) + 2
    held = panes.join(F.broadcast(windows), F.col("pane").between(F.col("window_start"), F.col("window_end")))  # a calendar
    sums = held.groupBy("window_start", "win", "ticker").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m"))
    fits = fitted(sums.where(F.col("n") >= min_obs), len(xs) + 1).select("window_start", "win", "ticker", "beta")
    of_pane = held.select("ticker", "pane", "window_start").join(fits, ["ticker", "window_start"]).groupBy("ticker", "pane").agg(F.collect_list(F.struct("window_start", "win", "beta")).alias("fits"))
    each = known.join(of_pane, ["ticker", "pane"]).withColumn("__fit", F.explode("fits"))
    fit = sum((F.col("__fit.beta")[i + 1] * F.col(x) for i, x in enumerate(xs)), F.col("__fit.beta")[0])
    return each.select("__fit.window_start", "__fit.win", "ticker", "date", (F.col(y) - fit).alias("residual"))


def loo_sector_factor(rows: DataFrame, y: str) -> DataFrame:
    """Mean of the sector's other tickers on the day; null if there are none."""
    w = W.partitionBy("date", "sector")
    n = F.count(y).over(w)
    return rows.withColumn("loo", F.when(n > 1, (F.sum(y).over(w) - F.col(y)) / (n - 1)))


def sector_residuals(rows: DataFrame, y: str, xs: list, min_obs: int = 60, share: float = 0.9) -> DataFrame:
    """OLS residuals with the leave-one-out sector factor where at least `share` of a ticker's days
    have peers, else without; the model used is named."""
    full = loo_sector_factor(rows, y)
    use = full.groupBy("ticker").agg((F.avg(F.col("loo").isNotNull().cast("double")) >= share).alias("use"))
    full = full.join(use, "ticker").withColumn("loo", F.when(F.col("use"), F.coalesce("loo", F.lit(0.0))))
    with_loo = ols_residuals(full.where("use"), ["ticker"], y, [*xs, "loo"], min_obs).withColumn("factor_model", F.lit("sector"))
    plain = ols_residuals(full.where("not use"), ["ticker"], y, xs, min_obs).withColumn("factor_model", F.lit("plain"))
    cols = ["ticker", "date", "residual", "factor_model"]
    return with_loo.select(*cols).unionByName(plain.select(*cols))


def one_residual(residuals: DataFrame, pick: str = "latest") -> DataFrame:
    """(ticker, date, residual): of a date's residuals that of the latest window that holds it; with
    'causal' that of the earliest, whose factors were fitted on the least of what follows."""
    of = F.max_by if pick == "latest" else F.min_by
    return residuals.groupBy("ticker", "date").agg(of("residual", "window_start").alias("residual"))


def oos_slice(rows: DataFrame, windows: DataFrame, lookback: int = 60) -> DataFrame:
    """Each window's rows from two lookbacks (in days) before its out-of-sample start to its end;
    oos_start tells them apart. windows is as long as a calendar."""
    inside = F.col("date").between(F.date_sub("oos_start", 2 * lookback), F.col("oos_end"))
    return rows.join(F.broadcast(windows.select("window_start", "win", "oos_start", "oos_end")), inside).drop("oos_end")


def stability(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Per pair over its significant windows: rows (ticker_i, ticker_j, win, lag, dcor, sharpness),
    with the half-life of its dCor; frequency is the share of all windows processed."""
    total = windows.agg(F.count(F.lit(1)).alias("__windows"))
    per = rows.groupBy("ticker_i", "ticker_j").agg(
        F.avg("dcor").alias("mean_dcor"), F.var_pop("dcor").alias("variance_dcor"), F.count_distinct("win").alias("n_windows_observed"),
        F.mode("lag", deterministic=True).alias("best_lag"), F.avg("sharpness").alias("sharpness"),
    )
    per = per.join(F.broadcast(total)).withColumn("frequency", F.col("n_windows_observed") / F.col("__windows")).drop("__windows")  # one row
    return per.join(half_life(rows), ["ticker_i", "ticker_j"])


def with_sharpness(rows: DataFrame, sharp: DataFrame, keys: list) -> DataFrame:
    """rows with each window's sharpness; a profile repeats it for every lag, so it is taken once."""
    return rows.join(sharp.select(*keys, "sharpness").distinct(), keys, "left")


#: Rates that bracket the best one: powers of ten in even steps.
RATES = 10.0 ** (-6.0 + np.arange(41) * (7.0 / 40))


def decay_rates(t: np.ndarray, y: np.ndarray, of: np.ndarray, rows: int, halvings: int = 60) -> np.ndarray:
    """The rate r of the least-squares fit of A * exp(-r * t), A >= 0, to each row's points; of is a
    point's row. For a given rate A has a closed form, so one number is searched: the best of RATES
    gives a bracket, in which the slope of the fit's quality is brought to zero by halving, for all
    rows at once. Where the slope doesn't change its sign there, the best of RATES stays."""
    sums = lambda v: np.bincount(of, weights=v, minlength=rows)

    def quality(r: np.ndarray) -> np.ndarray:
        e = np.exp(-r[of] * t)
        return np.maximum(sums(y * e), 0) ** 2 / sums(e * e)

    def slope(r: np.ndarray) -> np.ndarray:
        e = np.exp(-r[of] * t)
        return sums(y * e) * sums(t * e * e) - sums(t * y * e) * sums(e * e)

    left = sums(y * y)[:, None] - np.stack([quality(np.full(rows, r)) for r in RATES], 1)
    best = np.round(left, 12).argmin(axis=1)  # the smallest rate on ties
    lo, hi = RATES[np.maximum(best - 1, 0)], RATES[np.minimum(best + 1, len(RATES) - 1)]
    inside = (slope(lo) > 0) & (slope(hi) < 0)
    for _ in range(halvings):
        middle = np.sqrt(lo * hi)
        up = slope(middle) > 0
        lo, hi = np.where(up, middle, lo), np.where(up, hi, middle)
    return np.where(inside, np.sqrt(lo * hi), RATES[best])


def half_life(rows: DataFrame, step_days: int = 63, cap: float = 252.0) -> DataFrame:
    """(ticker_i, ticker_j, half_life, half_life_r2, half_life_stable): the decay of each pair's dCor, t
    being a window's number from the pair's first. A pair's windows are one row of arrays; all pairs
    of a batch are fitted together. Fewer than three windows have none (-1)."""
    prepared(rows.sparkSession)
    keys = ["ticker_i", "ticker_j"]
    lists = rows.where("win is not null and dcor is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("win", F.col("dcor").cast("double").alias("dcor")))).alias("s"))

    def run(batches):
        for batch in batches:
            s = batch.column("s")
            n = np.diff(np.asarray(s.offsets))
            of, points = np.repeat(np.arange(len(batch)), n), s.flatten()
            win, y = np.asarray(points.field("win")).astype(float), np.asarray(points.field("dcor"))
            t = win - np.repeat(win[np.cumsum(n) - n], n)
            rate = decay_rates(t, y, of, len(batch))
            sums = lambda v: np.bincount(of, weights=v, minlength=len(batch))  # noqa: E731, B023
            e = np.exp(-rate[of] * t)
            ye, ee, total = sums(y * e), sums(e * e), sums(y * y) - sums(y) ** 2 / n
            a = np.maximum(ye / ee, 0)
            sse = sums(y * y) - 2 * a * ye + a * a * ee
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = np.where(n < 3, 0.0, np.where(total > 1e-12, 1 - sse / total, 0.0))
            life = np.where(n < 3, -1.0, np.minimum(np.log(2.0) / rate * step_days, cap))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(life), pa.array(r2), pa.array((n >= 3) & (r2 >= 0.30))], [*keys, "half_life", "half_life_r2", "half_life_stable"])

    kind = dict(rows.dtypes)
    return lists.mapInArrow(run, f"ticker_i {kind['ticker_i']}, ticker_j {kind['ticker_j']}, half_life double, half_life_r2 double, half_life_stable boolean")


def trailing_zscore(rows: DataFrame, value: str, lookback: int = 60, keys=("ticker",), order: str = "date") -> DataFrame:
    """Against the lookback rows before the current one, population deviation."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-lookback, -1)
    sd = F.stddev_pop(value).over(w)
    return rows.withColumn("z", F.when((F.count(value).over(w) == lookback) & (sd > 1e-10), (F.col(value) - F.avg(value).over(w)) / sd))


def trailing_scores(x: np.ndarray, lookback: int) -> np.ndarray:
    """Each value against the lookback values before it, population deviation; NaN without them or
    where they hardly vary."""
    out = np.full(len(x), np.nan)
    if len(x) > lookback:
        before = np.lib.stride_tricks.sliding_window_view(x, lookback)[:-1]
        sd = before.std(axis=1)
        out[lookback:] = np.where(sd > 1e-10, (x[lookback:] - before.mean(axis=1)) / np.maximum(sd, 1e-10), np.nan)
    return out


def _traded(leader: DataFrame, follower: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(ticker_i, ticker_j, lag, direction) with both series as arrays: a row a pair shuffles."""
    x, y = (series_arrays(df).select(F.col("ticker").alias(f"ticker_{e}"), F.col("d").alias(f"{n}d"), F.col("v").alias(f"{n}v")) for df, e, n in ((leader, "i", "x"), (follower, "j", "y")))
    sign = F.when(F.coalesce("direction", F.lit(1.0)) < 0, -1).otherwise(1).alias("sign")
    return pairs.select(*ENDS, F.col("lag").cast("int").alias("lag"), sign).join(x, "ticker_i").join(y, "ticker_j")


def _days_of(batch: pa.RecordBatch, lookback: int, cost: float, start=None, end=None):
    """(row, days, signal, position, gross, net) of the days of each pair that have a signal."""
    lags, signs = batch.column("lag").to_pylist(), batch.column("sign").to_pylist()
    for i, days, x, y in common_days(batch, 1):
        lag = lags[i]
        if lag is None or len(x) < lookback + lag + 10:
            continue
        signal = np.full(len(x), np.nan)
        signal[lag:] = trailing_scores(x, lookback)[: len(x) - lag]
        on = np.flatnonzero(~np.isnan(signal) & ((days >= start) & (days <= end) if start is not None else True))
        position = signs[i] * ((signal[on] > 1).astype(np.int32) - (signal[on] < -1).astype(np.int32))
        gross = position * y[on]
        yield i, days[on], signal[on], position, gross, gross - cost * np.abs(position)


def strategy_returns(leader: DataFrame, follower: DataFrame, pairs: DataFrame, lookback: int, cost_bps: float = 10.0, start=None, end=None) -> DataFrame:
    """(ticker_i, ticker_j, date, lag, signal, position, gross, net) for pairs(ticker_i, ticker_j, lag,
    direction): the leader's z-score, `lag` common rows earlier, sets the position in the follower.
    Alignment, scores and positions are made inside the kernel, from a row of arrays a pair."""
    between = [(datetime.date.fromisoformat(str(d)) - datetime.date(1970, 1, 1)).days for d in (start, end)] if start is not None else (None, None)

    def run(batch):
        got = list(_days_of(batch, lookback, cost_bps / 1e4, *between))
        of = np.repeat([g[0] for g in got], [len(g[1]) for g in got]) if got else np.zeros(0, np.int64)
        column = lambda k, kind: np.concatenate([g[k] for g in got]).astype(kind) if got else np.zeros(0, kind)
        return of, [pa.array(column(1, np.int32)).cast(pa.date32()), *(column(k, t) for k, t in ((2, float), (3, np.int32), (4, float), (5, float)))]

    out = mapped(_traded(leader, follower, pairs), run, "date date, signal double, position int, gross double, net double", [*ENDS, "lag"])
    return out.select(*ENDS, "date", "lag", "signal", "position", "gross", "net")


def strategy_sharpes(leader: DataFrame, follower: DataFrame, pairs: DataFrame, lookback: int, cost_bps: float = 10.0, periods: int = 252, least: int = 30) -> DataFrame:
    """(ticker_i, ticker_j, sharpe_gross, sharpe_net, n_days, best_lag) of the pairs' strategies with
    `least` days or more, straight from the kernel: no row a day leaves it."""

    def ratio(r: np.ndarray) -> float | None:
        sd = float(r.std())
        return float(r.mean()) / sd * periods**0.5 if sd > 1e-10 else None

    def run(batch):
        got = [(g[0], ratio(g[4]), ratio(g[5]), len(g[1])) for g in _days_of(batch, lookback, cost_bps / 1e4) if len(g[1]) >= least]
        return [g[0] for g in got], [pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64())]

    out = mapped(_traded(leader, follower, pairs), run, "sharpe_gross double, sharpe_net double, n_days long", [*ENDS, "lag"])
    return out.withColumnRenamed("lag", "best_lag")


def annualized_vol(prices: DataFrame, days: int = 365, least: int = 50) -> DataFrame:
    """(ticker, vol): sample deviation of the log returns of adjusted closes in the last days, a year's."""
    last = prices.agg(F.date_sub(F.max("date"), days).alias("__from"))
    some = prices.join(F.broadcast(last)).where(F.col("date") > F.col("__from"))  # one row
    r = some.withColumn("r", F.log(F.col("adj_close") / F.nullif(F.lag("adj_close").over(W.partitionBy("ticker").orderBy("date")), F.lit(0.0))))
    return r.groupBy("ticker").agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"), F.count("r").alias("n")).where(F.col("n") >= least).drop("n")


def sharpe(value: str, periods: int = 252, least: int = 10) -> Column:
    sd = F.stddev_pop(value)
    return F.when((F.count(value) >= least) & (sd > 1e-10), F.avg(value) / sd * F.sqrt(F.lit(float(periods))))


def sortino(value: str | Column, periods: int = 252) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    down = F.stddev_samp(F.when(v < 0, v)) * F.sqrt(F.lit(float(periods)))
    return F.when(down > 1e-10, F.avg(v) * periods / down)


def signal_strength(df: DataFrame, score: str, keys: list | None = None) -> DataFrame:
    """Winsorised at the exact 5th and 95th percentile (of each group of keys), scaled to 0-100; flat
    gives 50. Percentiles of the whole table are selected by rank; those of groups are an aggregate
    that is joined."""
    if keys:
        cut = df.groupBy(*keys).agg(F.percentile(score, F.array(F.lit(0.05), F.lit(0.95))).alias("__p"))
        df, lo, hi = df.join(cut, keys), F.col("__p")[0], F.col("__p")[1]
    else:
        lo, hi = (F.lit(x).cast("double") for x in exact_quantiles(df, {score: F.col(score)}, (0.05, 0.95))[score])
    x = F.least(F.greatest(F.col(score), lo), hi)
    return df.withColumn("signal_strength", F.when(hi > lo, (x - lo) / (hi - lo) * 100).otherwise(50.0)).drop("__p")


def predicted_score(df: DataFrame, weights: dict, intercept: float) -> DataFrame:
    return df.withColumn("predicted", sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(intercept)))


def bootstrap_ci(rows: DataFrame, y: str, xs: list, resamples: int, order: list, seed: int = 0) -> DataFrame:
    """(feature, mean, std, ci_lower, ci_upper): coefficients of an OLS refitted on resamples of as
    many rows, drawn with replacement: draw k of resample b takes the row with the number that the
    md5 of (seed, b, k) points at, rows being numbered in the given order. Draws, not rows, are
    multiplied; they join rows by number, and a resample is a sum of moments."""
    prepared(rows.sparkSession)
    known = staged(numbered(rows.select(*order, y, *xs), [F.col(c) for c in order], "k"), "numbered")
    total = known.agg(F.count(F.lit(1)).alias("n"))
    drawn = known.select("k").join(F.broadcast(total)).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))  # one row
    u = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("b").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = drawn.select("b", (1 + F.floor(u * F.col("n"))).cast("long").alias("k")).groupBy("b", "k").agg(F.count(F.lit(1)).cast("double").alias("w"))
    agg = times.join(known, "k").groupBy("b").agg(F.sum("w").cast("long").alias("n"), _moments(y, xs, F.col("w")).alias("m"))
    long = fitted(agg, len(xs) + 1).select("b", F.posexplode("beta").alias("i", "beta")).withColumn("feature", named_term("i", xs))
    return long.groupBy("feature").agg(F.avg("beta").alias("mean"), F.stddev_samp("beta").alias("std"), F.percentile("beta", 0.025).alias("ci_lower"), F.percentile("beta", 0.975).alias("ci_upper"))


def named_term(number: str, xs: list) -> Column:
    return F.element_at(F.array(F.lit("intercept"), *map(F.lit, xs)), F.col(number) + 1)


def score_regression(rows: DataFrame, y: str, xs: list, min_pairs: int = 20) -> DataFrame:
    """(feature, weight, r2, f, n): OLS of y on xs over rows with all of them and half_life over 0."""
    full = rows.where("half_life > 0").dropna(subset=[y, *xs])
    return ols(full, [], y, xs, min_pairs).select("n", "r2", "f", F.posexplode("beta").alias("i", "weight")).withColumn("feature", named_term("i", xs)).drop("i")


def feature_importance(weights: DataFrame, ci: DataFrame, digits: int = 4) -> DataFrame:
    """The current weights with their intervals, largest effect first in the reader's order; no intercept."""
    both = weights.where("feature != 'intercept'").join(ci, "feature", "left")
    return both.select("feature", *[F.round(F.col(c) + 1e-9, digits).alias(c) for c in ("weight", "ci_lower", "ci_upper")])


def deciles(df: DataFrame, score: str, value: str) -> DataFrame:
    """By quantile edges, right-closed with the lowest included and equal edges merged. Edges, and the
    median of each decile, are selected by rank; rows without a score are in the first."""
    edges = sorted({e for e in exact_quantiles(df, {score: F.col(score)}, [k / 10 for k in range(11)])[score] if e is not None})
    below = F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>"), lambda e: e < F.col(score)))
    inner = df.withColumn("decile", F.greatest(F.lit(1), below))
    parts = {str(k): F.when(F.col("decile") == k, F.col(value)) for k in range(1, 11)}
    medians = exact_quantiles(inner, parts, (0.5,))
    middle = F.element_at(F.array(*[F.lit(medians[str(k)][0]).cast("double") for k in range(1, 11)]), F.col("decile"))
    per = inner.groupBy("decile").agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
    return per.select("decile", "mean_value", middle.alias("median_value"), "n", "mean_score")


def robust_scale(df: DataFrame, columns: list) -> DataFrame:
    """(x - median) / IQR with quartiles selected by rank; an IQR of 0 counts as 1."""
    quartiles, out = exact_quantiles(df, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75)), df
    for c, (low, middle, high) in quartiles.items():
        low, middle, high = (F.lit(x).cast("double") for x in (low, middle, high))
        iqr = high - low
        out = out.withColumn(c, (F.col(c) - middle) / F.when(iqr == 0, 1.0).otherwise(iqr))
    return out


def drop_correlated(df: DataFrame, columns: list, limit: float = 0.85) -> list:
    """Columns left when each that correlates with an earlier one beyond the limit goes. One row of
    correlations reaches the driver."""
    names = [(a, b) for j, b in enumerate(columns) for a in columns[:j]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in names]).first() if names else {}
    return [b for j, b in enumerate(columns) if not any(abs(row[f"{a}|{b}"] or 0.0) > limit for a in columns[:j])]


def average_rank_pct(value: str, partition: list, descending: bool = False) -> Column:
    """Average-rank percentile within a partition over rows that have a value; null for others. For
    a whole table there is ranks.average_rank_pct."""
    has = F.col(value).isNotNull()
    part = W.partitionBy(*partition, has)
    rank = F.rank().over(part.orderBy(F.col(value).desc() if descending else F.col(value).asc()))
    ties = F.count(F.lit(1)).over(W.partitionBy(*partition, value))
    return F.when(has, (rank + (ties - 1) / 2) / F.count(F.lit(1)).over(part))


def detection_quality(rows: DataFrame, n_true: int) -> DataFrame:
    """rows(truth, significant, dcor): rates over decisions, and true pairs among the n_true best."""
    ranked = average_ranked(rows, "dcor", "__r", descending=True)
    tpr = F.try_divide(F.count_if(F.col("truth") & F.col("significant")), F.count_if(F.col("truth")))
    fpr = F.try_divide(F.count_if(~F.col("truth") & F.col("significant")), F.count_if(~F.col("truth")))
    top = F.try_divide(F.count_if(F.col("truth") & (F.col("__r") <= n_true)), F.count_if(F.col("truth")))
    return ranked.agg(tpr.alias("tpr"), fpr.alias("fpr"), top.alias("rank_accuracy"), F.when((tpr >= 0.7) & (fpr <= 0.1), "PASS").otherwise("WARN").alias("status"))
