"""Risk on a scenario table (sim_id, step, ticker, price), and its making by block bootstrap."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import sortino
from .windows import max_drawdown, time_to_recovery


def _draw(seed: int, *parts) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def block_draws(sims: DataFrame, positions: DataFrame, length: int, block: int = 21, seed: int = 7) -> DataFrame:
    """(sim_id, step, pos): for each simulation, blocks of consecutive positions, their starts uniform
    over 1..n - block (n: the rows of positions, at least one start), cut to length."""
    total = positions.agg(F.count(F.lit(1)).alias("__n"))
    drawn = sims.select("sim_id", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("step")).withColumn("b", F.floor((F.col("step") - 1) / block)).join(F.broadcast(total))  # one row
    start = F.floor(_draw(seed, F.col("sim_id"), F.col("b")) * F.greatest(F.col("__n") - block, F.lit(1)))
    return drawn.select("sim_id", "step", (1 + start + (F.col("step") - 1) % block).cast("int").alias("pos"))


def dated_returns(returns: DataFrame) -> DataFrame:
    """(ticker, pos, log_return): every ticker on every date of the table, numbered; a date that a
    ticker misses is a return of 0. Dates are as many as a calendar has."""
    dates = returns.where("log_return is not null").select("date").distinct()
    dates = dates.withColumn("pos", F.row_number().over(W.orderBy("date")))
    last = dates.agg(F.max("pos").alias("__last"))
    grid = returns.select("ticker").distinct().join(F.broadcast(last)).select("ticker", F.explode(F.sequence(F.lit(1), "__last")).alias("pos"))  # one row
    have = returns.where("log_return is not null").select("ticker", "date", "log_return").join(dates, "date").select("ticker", "pos", "log_return")
    return grid.join(have, ["ticker", "pos"], "left").select("ticker", "pos", F.coalesce("log_return", F.lit(0.0)).alias("log_return"))


def scenario_paths(dated: DataFrame, draws: DataFrame) -> DataFrame:
    """Cumulative growth from 1 along shared draws, so that tickers keep their cross-correlation."""
    w = W.partitionBy("sim_id", "ticker").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return draws.join(dated.select("ticker", "pos", "log_return"), "pos").select("sim_id", "step", "ticker", F.exp(F.sum("log_return").over(w)).alias("price"))


def bands(paths: DataFrame, keys: list, value: str, percents=(5, 16, 50, 84, 95)) -> DataFrame:
    q = paths.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(p / 100) for p in percents])).alias("q"), F.avg(value).alias("mean"), F.avg((F.col(value) > 1).cast("double")).alias("p_up"))
    return q.select(*keys, "mean", "p_up", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(percents)])


def band_coverage(band: DataFrame, actual: DataFrame, keys: list) -> DataFrame:
    return band.join(actual, keys).agg(F.avg(F.col("actual").between(F.col("p16"), F.col("p84")).cast("double")).alias("coverage"))


def resolve_weights(tickers: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Equal weights, or the given ones of available tickers, adding up to 1."""
    w = tickers.select("ticker").distinct()
    w = w.withColumn("w", F.lit(1.0)) if given is None else w.join(given.select("ticker", F.col("weight").alias("w")), "ticker")
    return w.join(F.broadcast(w.agg(F.sum("w").alias("t")))).select("ticker", (F.col("w") / F.col("t")).alias("weight"))


def portfolio_paths(paths: DataFrame, weights: DataFrame) -> DataFrame:
    return paths.join(weights, "ticker").groupBy("sim_id", "step").agg((1 + F.sum(F.col("weight") * (F.col("price") - 1))).alias("price"))


def terminal(paths: DataFrame, keys: list) -> DataFrame:
    return paths.groupBy("sim_id", *keys).agg((F.max_by("price", "step") - 1).alias("r"))


def tail_measures(ends: DataFrame, keys: list, level: float = 0.95, target: float = 0.1) -> DataFrame:
    """VaR, CVaR, tail ratio, shares of loss and of the target, population skewness of r."""
    one = ends if keys else ends.withColumn("__all", F.lit(1))
    by = keys or ["__all"]
    q = one.groupBy(*by).agg(F.percentile("r", 1 - level).alias("var"), F.avg((F.col("r") < 0).cast("double")).alias("prob_loss"), F.avg((F.col("r") >= target).cast("double")).alias("prob_target"), F.skewness("r").alias("skew"), F.avg("r").alias("mean"))
    tail = one.join(q.select(*by, "var"), by).where("r <= var").groupBy(*by).agg(F.avg("r").alias("cvar"))
    return q.join(tail, by).withColumn("tail_ratio", F.when(F.abs("var") <= 1e-10, 1.0).otherwise(F.col("cvar") / F.col("var"))).drop("__all")


def drawdown_summary(paths: DataFrame, keys: list) -> DataFrame:
    d = max_drawdown(paths, "price", ["sim_id", *keys], "step")
    one = d if keys else d.withColumn("__all", F.lit(1))
    return one.groupBy(*(keys or ["__all"])).agg(F.avg("max_drawdown").alias("mean_drawdown"), F.percentile("max_drawdown", 0.05).alias("worst_p5")).drop("__all")


def recovery_summary(paths: DataFrame, keys: list, least: float = 0.1) -> DataFrame:
    """Mean recovery, if at least that share of simulations recovers."""
    r = time_to_recovery(paths, "price", ["sim_id", *keys], "step")
    one = r if keys else r.withColumn("__all", F.lit(1))
    return one.groupBy(*(keys or ["__all"])).agg(F.when(F.count("recovery") >= least * F.count(F.lit(1)), F.avg("recovery")).alias("recovery")).drop("__all")


def risk_table(paths: DataFrame, keys: list, returns: DataFrame, level: float = 0.95, target: float = 0.1) -> DataFrame:
    """Every measure of each group of keys, or of the whole as one row: tail of the terminal returns,
    drawdown, recovery, and the Sortino ratio of the stored returns(keys, log_return)."""
    down = (returns.groupBy(*keys) if keys else returns.groupBy()).agg(sortino("log_return").alias("sortino"))
    parts = [tail_measures(terminal(paths, keys), keys, level, target), drawdown_summary(paths, keys), recovery_summary(paths, keys), down]
    return reduce(lambda a, b: a.join(b, keys, "left") if keys else a.join(b), parts)


def diversification_benefit(paths: DataFrame, weights: DataFrame, level: float = 0.95) -> DataFrame:
    alone = tail_measures(terminal(paths, ["ticker"]), ["ticker"], level).join(weights, "ticker").agg(F.sum(F.col("weight") * F.col("var")).alias("alone"))
    return tail_measures(terminal(portfolio_paths(paths, weights), []), [], level).select("var").join(alone).select((F.col("var") - F.col("alone")).alias("benefit"))


def risk_contribution(paths: DataFrame, weights: DataFrame, level: float = 0.95) -> DataFrame:
    """weight * mean return in the portfolio's tail simulations, and its share of the total."""
    ends = terminal(portfolio_paths(paths, weights), [])
    cut = ends.agg(F.percentile("r", 1 - level).alias("var"))
    tail = ends.join(F.broadcast(cut)).where("r <= var").select("sim_id")
    c = terminal(paths, ["ticker"]).join(tail, "sim_id", "left_semi").groupBy("ticker").agg(F.avg("r").alias("m")).join(weights, "ticker").select("ticker", (F.col("weight") * F.col("m")).alias("contribution"))
    return c.join(F.broadcast(c.agg(F.sum("contribution").alias("t")))).select("ticker", "contribution", F.try_divide("contribution", "t").alias("share"))


def return_histogram(ends: DataFrame, lo: float, hi: float, bins: int, var: float) -> DataFrame:
    return ends.select(F.width_bucket("r", F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin"), (F.col("r") <= var).alias("tail")).groupBy("bin", "tail").agg(F.count(F.lit(1)).alias("n"))
