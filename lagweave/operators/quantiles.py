"""Exact quantiles of a whole table by selection by rank: no task sorts or merges all of a column.

The range of each column is cut into BUCKETS equal parts and rows are counted in each (a row a bucket
and task shuffles). A bucket that holds a wanted rank is cut again, between the least and the largest
value in it, until all values of a bucket are equal or few enough to be ordered; only values in such
buckets are ever ordered. Every pass reads the columns once, for all columns and ranks together, and
brings the driver a bounded table: the buckets with wanted ranks. Passes end at the latest when a
bucket is one value, each making the open ranges 1/BUCKETS as long.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: Values of a bucket that are ordered in one array.
FEW = 4096


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float], buckets: int = BUCKETS, few: int = FEW) -> dict[str, list[float | None]]:
    """{name: quantiles}: linear between the two nearest values, as Spark's percentile gives them bit
    for bit. Nulls don't count, NaN is larger than all numbers; a column without values has None."""
    names = list(columns)
    # a small number for each column, so that one pass serves them all
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), columns[n].cast("double").alias("x")) for i, n in enumerate(names)])).alias("v")).select("v.*").where("x is not null")
    finite = ~F.isnan("x") & (F.abs("x") < float("inf"))
    size = F.count(F.lit(1))
    first = long.groupBy("c").agg(size.alias("n"), F.count_if(F.col("x") == float("-inf")).alias("low"), F.count_if(finite).alias("mid"), F.count_if(F.col("x") == float("inf")).alias("high"), F.min(F.when(finite, F.col("x"))).alias("lo"), F.max(F.when(finite, F.col("x"))).alias("hi"))
    totals = {r.c: r for r in first.collect()}  # a row a column
    known: dict[tuple[int, int], float] = {}
    wanted: dict[int, set] = {}
    open_: list[tuple] = []  # (column, lo, hi, values before, values)
    for c, r in totals.items():
        ranks = {k for p in probs for k in (math.floor((r.n - 1) * p), math.ceil((r.n - 1) * p))}
        wanted[c] = ranks
        for k in ranks:
            if k < r.low:
                known[c, k] = float("-inf")
            elif k >= r.low + r.mid:
                known[c, k] = float("inf") if k < r.low + r.mid + r.high else float("nan")
        if r.mid:
            open_.append((c, r.lo, r.hi, r.low, r.mid))
    while open_:
        cut, ordered = [], []
        for b in open_:
            c, lo, hi, before, n = b
            if mine := [k for k in wanted[c] if before <= k < before + n]:
                if lo == hi:
                    known |= {(c, k): lo for k in mine}
                else:
                    (ordered if n <= few else cut).append(b)
        open_ = []
        if ordered:
            inside = _inside(long, ordered)
            for r in inside.groupBy("b").agg(F.sort_array(F.collect_list("x")).alias("xs")).collect():
                c, _, _, before, _ = ordered[r.b]
                known |= {(c, k): r.xs[k - before] for k in wanted[c] if before <= k < before + len(r.xs)}
        if cut:
            inside = _inside(long, cut)
            half = F.col("x") / 2 - F.col("lo") / 2  # halves, as hi - lo can be over the largest double
            at = F.least(F.lit(buckets - 1), F.floor(half / (F.col("hi") / 2 - F.col("lo") / 2) * buckets).cast("int"))
            counts = inside.withColumn("at", at).groupBy("b", "at").agg(size.alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            seen = dict.fromkeys(range(len(cut)), 0)
            for r in sorted(counts.collect(), key=lambda r: (r.b, r.at)):  # BUCKETS rows a range at most
                before = cut[r.b][3] + seen[r.b]
                seen[r.b] += r.n
                open_.append((cut[r.b][0], r.lo, r.hi, before, r.n))

    def quantile(c: int, p: float) -> float | None:
        if c not in totals:
            return None
        at = (totals[c].n - 1) * p
        lower, upper = math.floor(at), math.ceil(at)
        a, b = known[c, lower], known[c, upper]
        return a if lower == upper or a == b else (upper - at) * a + (at - lower) * b

    return {n: [quantile(i, p) for p in probs] for i, n in enumerate(names)}


def _inside(long: DataFrame, ranges: list[tuple]) -> DataFrame:
    """The values of each range, with its number b and its ends. Ranges of a column don't overlap, and
    there are two for each wanted quantile at most."""
    rows = [(b, c, lo, hi) for b, (c, lo, hi, _, _) in enumerate(ranges)]
    table = long.sparkSession.createDataFrame(rows, "b int, c int, lo double, hi double")
    return long.join(F.broadcast(table), "c").where(F.col("x").between(F.col("lo"), F.col("hi")))
