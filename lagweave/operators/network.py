"""The scored network: queries, graph measures, portfolio operators, diversification by clusters."""

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import dropped, staged
from .quantiles import exact_quantiles
from .ranks import average_rank_pct


def latest_snapshot(edges: DataFrame, date: str = "as_of_date") -> DataFrame:
    """Rows of the newest date: a one-row aggregate that is joined, so partitions can be pruned."""
    return edges.join(F.broadcast(edges.agg(F.max(date).alias(date))), date, "left_semi")


def network_query(edges: DataFrame, min_score=None, sector=None, lag=None, ticker=None, scope=None, limit: int = 1000) -> DataFrame:
    """Edges by any of the filters; scope is 'intra' or 'inter' sector."""
    tests = []
    if min_score is not None:
        tests.append(F.col("signal_strength") >= min_score)
    if sector is not None:
        tests.append((F.col("sector_i") == sector) | (F.col("sector_j") == sector))
    if lag is not None:
        tests.append(F.col("best_lag") == lag)
    if ticker is not None:
        tests.append((F.col("ticker_i") == ticker) | (F.col("ticker_j") == ticker))
    if scope is not None:
        tests.append((F.col("sector_i") == F.col("sector_j")) if scope == "intra" else (F.col("sector_i") != F.col("sector_j")))
    return reduce(DataFrame.where, tests, edges).orderBy(F.desc("signal_strength"), "ticker_i", "ticker_j").limit(min(limit, 1000))


def pair_detail(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The pair's newest row in either orientation; one row that says so if there is none."""
    hit = edges.where(((F.col("ticker_i") == a) & (F.col("ticker_j") == b)) | ((F.col("ticker_i") == b) & (F.col("ticker_j") == a))).orderBy(F.desc("as_of_date"), F.desc("signal_strength"), "ticker_i").limit(1)
    asked = edges.sparkSession.range(1).select(F.lit(a).alias("asked_a"), F.lit(b).alias("asked_b"))
    return asked.join(hit.withColumn("__k", F.lit(1)), F.col("__k") == 1, "left").withColumn("found", F.col("__k").isNotNull()).drop("__k")


def ticker_search(meta: DataFrame, other: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Tickers that start with the text, then names that contain it; tickers of `other` without
    metadata count by ticker only."""
    up = text.upper()
    known = meta.select("ticker", "company_name")
    more = other.select("ticker").distinct().join(known, "ticker", "left_anti").withColumn("company_name", F.lit(None).cast("string"))
    every = known.unionByName(more)
    first = F.upper("ticker").startswith(up)
    hit = every.withColumn("place", F.when(first, 0).when(F.upper("company_name").contains(up), 1)).where("place is not null")
    return hit.orderBy("place", "ticker").limit(max(1, min(limit, 50)))


def both_ends(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: (ticker, other, leads, ...)."""
    keep = [c for c in edges.columns if c not in ("ticker_i", "ticker_j", "sector_i", "sector_j", "centrality_i", "centrality_j")]
    side = lambda a, b, leads: edges.select(F.col(f"ticker_{a}").alias("ticker"), F.col(f"ticker_{b}").alias("other"), F.lit(leads).alias("leads"), F.col(f"sector_{a}").alias("sector"), F.col(f"sector_{b}").alias("other_sector"), F.col(f"centrality_{a}").alias("centrality"), *keep)
    return side("i", "j", True).unionByName(side("j", "i", False))


def node_centrality(edges: DataFrame, side: str = "both") -> DataFrame:
    e = both_ends(edges)
    return (e if side == "both" else e.where("leads")).groupBy("ticker").agg(F.max("centrality").alias("centrality"), F.min("sector").alias("sector"))


def top_nodes_edges(edges: DataFrame, k: int, limit: int = 2000) -> DataFrame:
    """Edges between the k most central nodes."""
    top = node_centrality(edges).orderBy(F.desc("centrality"), "ticker").limit(k).select("ticker")
    i, j = (F.broadcast(top.withColumnRenamed("ticker", f"ticker_{x}")) for x in "ij")
    return edges.join(i, "ticker_i", "left_semi").join(j, "ticker_j", "left_semi").orderBy(F.desc("signal_strength"), "ticker_i", "ticker_j").limit(limit)


def holding_edges(edges: DataFrame, holdings: DataFrame) -> DataFrame:
    """Edges that touch a holding: two semi joins, the second without the first's rows, rather than
    an OR, which would be a nested loop."""
    i, j = (holdings.select(F.col("ticker").alias(f"ticker_{x}")).distinct() for x in "ij")
    return edges.join(i, "ticker_i", "left_semi").unionByName(edges.join(i, "ticker_i", "left_anti").join(j, "ticker_j", "left_semi"))


def overlap_pairs(edges: DataFrame, holdings: DataFrame) -> DataFrame:
    i, j = (holdings.select(F.col("ticker").alias(f"ticker_{x}")).distinct() for x in "ij")
    return edges.join(i, "ticker_i", "left_semi").join(j, "ticker_j", "left_semi").orderBy(F.desc("signal_strength"), "ticker_i", "ticker_j")


def normalize_holdings(raw: DataFrame, known: DataFrame) -> DataFrame:
    """(ticker, known): trimmed, upper case, no blanks, once each."""
    t = raw.select(F.upper(F.trim("symbol")).alias("k")).where("k != ''").distinct()
    names = known.select(F.upper("ticker").alias("k"), "ticker").distinct()
    return t.join(names, "k", "left").select(F.coalesce("ticker", "k").alias("ticker"), F.col("ticker").isNotNull().alias("known"))


def unconnected(edges: DataFrame, universe: DataFrame, holdings: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Universe without the holdings and what is linked to them."""
    linked = both_ends(edges.where(F.col("signal_strength") >= min_score)).join(holdings.select(F.col("ticker").alias("other")), "other", "left_semi").select("ticker")
    return universe.select("ticker").distinct().join(holdings, "ticker", "left_anti").join(linked, "ticker", "left_anti")


def signal_recs(edges: DataFrame, meta: DataFrame, holdings: DataFrame, min_score: float = 55.0, limit: int = 10) -> DataFrame:
    """Candidates linked to holdings, scored by link strength, durability, coverage, sector
    diversity and centrality."""
    held = holdings.select(F.col("ticker").alias("other"))
    links = both_ends(edges.where(F.col("signal_strength") >= min_score)).join(held, "other", "left_semi").join(holdings, "ticker", "left_anti")
    per = links.groupBy("ticker").agg(
        F.try_divide(F.sum(F.col("signal_strength") * F.col("frequency")), F.sum("frequency")).alias("signal"), F.count_distinct("other").alias("links"), F.max("half_life").alias("life"),
        F.max("centrality").alias("centrality"), F.min("sector").alias("sector"), F.bool_or("leads").alias("any_leads"), F.bool_and("leads").alias("all_lead"), F.array_sort(F.collect_set("other")).alias("related"),
    )
    share = holdings.join(meta, "ticker").groupBy("sector").agg(F.count(F.lit(1)).alias("held"))
    total = holdings.agg(F.count(F.lit(1)).alias("n"))
    ends = per.agg(F.max("links").alias("max_links"), (F.max("centrality") > 0).alias("has_centrality"))
    x = per.join(share, "sector", "left").join(F.broadcast(total)).join(F.broadcast(ends))
    w = F.when(F.col("has_centrality"), 0.40).otherwise(0.50)
    score = w * F.coalesce("signal", F.lit(0.0)) + 0.15 * F.least("life", F.lit(252.0)) / 252 * 100 + 0.15 * F.col("links") / F.col("max_links") * 100 + 0.20 * (1 - F.coalesce("held", F.lit(0)) / F.col("n")) * 100 + F.when(F.col("has_centrality"), 0.10 * F.col("centrality") * 100).otherwise(0.0)
    way = F.when(F.col("all_lead"), "leads").when(F.col("any_leads"), "both").otherwise("follows")
    return x.select("ticker", F.round(score + 1e-9, 4).alias("score"), way.alias("direction"), "links", F.array_join("related", ",").alias("related")).orderBy(F.desc("score"), "ticker").limit(limit)


def independent_recs(edges: DataFrame, meta: DataFrame, holdings: DataFrame, min_score: float, limit: int = 10) -> DataFrame:
    free = unconnected(edges, meta, holdings, min_score)
    held = holdings.join(meta, "ticker").select("sector").distinct().withColumn("has", F.lit(True))
    x = free.join(meta.select("ticker", "sector"), "ticker").join(held, "sector", "left").join(node_centrality(edges).select("ticker", "centrality"), "ticker", "left")
    return x.select("ticker", (0.7 * F.when(F.col("has"), 0.0).otherwise(1.0) + 0.3 * F.coalesce("centrality", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "ticker").limit(limit)


def build_edges(edges: DataFrame, min_score: float) -> DataFrame:
    return edges.where(F.col("signal_strength") >= min_score).select(F.col("ticker_i").alias("src"), F.col("ticker_j").alias("dst"), (F.col("signal_strength") / 100).alias("weight"), "best_lag")


def degree_centrality(graph: DataFrame) -> DataFrame:
    out, into = graph.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o")), graph.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    d = out.join(into, "node", "full")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    share = lambda c: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.col("n") - 1), F.lit(0.0))
    return d.join(F.broadcast(n)).select("node", share("i").alias("in_degree"), share("o").alias("out_degree"))


def _fixed(links: DataFrame, key: str) -> DataFrame:
    """links dealt out by one end and kept so: a round's vector goes to them, they don't move again."""
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links.repartition(n, key).persist()


#: Rounds between two extrapolations.
CYCLE = 5


def _until(x: DataFrame, step, tolerance: float, most: int) -> DataFrame:
    """x(node, x, ...) after steps until the sum of absolute changes of a round is under tolerance, or
    most rounds. step(x, keep) keeps the columns and those of keep, and adds was, the value before.

    After CYCLE rounds the next one starts from the combination of their vectors, with weights that
    add up to one, whose change would be least (reduced-rank extrapolation), which saves most rounds of
    a slow convergence; weights come from a CYCLE x CYCLE table of products. Nothing else but a number
    a round reaches the driver. Each round's vector is staged, so a lost executor costs no more than
    a round."""
    columns, nodes, past = x.columns, x.count(), []
    for _ in range(most):
        new = staged(step(x, past).withColumnRenamed("was", f"h{len(past)}"), "round", spent=(x,), rows=nodes)
        past = [*past, f"h{len(past)}"]
        values = [F.col(c) for c in (*past, "x")]
        changes = [b - a for a, b in zip(values, values[1:])]
        full = len(past) == CYCLE
        products = [F.sum(a * b) for a in changes for b in changes] if full else []
        residual, *gram = new.agg(F.sum(F.abs(changes[-1])), *products).first()
        out = new
        if full:
            g = np.array(gram, float).reshape(CYCLE, CYCLE) if residual else np.zeros((CYCLE, CYCLE))
            weights = np.linalg.pinv(g, rcond=1e-13, hermitian=True).sum(axis=1)
            good = residual is not None and residual >= tolerance and abs(weights.sum()) > 0
            mixed = sum((float(w) * v for w, v in zip(weights / weights.sum(), values[1:])), F.lit(0.0)) if good else F.col("x")
            out, past = new.withColumn("x", mixed).select(*columns), []
        out._staged_at = new._staged_at
        x = out
        if residual is None or residual < tolerance:
            break
    return x


def eigen_centrality(graph: DataFrame, tolerance: float = 1e-10, most: int = 500) -> DataFrame:
    """Power iteration on A + I of the undirected graph (of two edges between the same nodes the
    heavier stays), L2 norm, until a round changes the vector by less than tolerance in sum. A + I
    has no eigenvalue as large as its largest with the other sign, so it converges on bipartite
    graphs too. An empty graph gives no rows."""
    u = graph.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("w"))
    both = u.select("a", "b", "w").unionByName(u.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = staged(both, "links")
    fixed = _fixed(both, "b")
    start = staged(both.select(F.col("a").alias("node")).distinct().withColumn("x", F.lit(1.0)), "round")

    def step(x: DataFrame, keep: list) -> DataFrame:
        near = fixed.join(x, F.col("b") == F.col("node")).groupBy("a").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
        y = x.join(near, F.col("node") == F.col("a"), "left").select("node", *keep, F.col("x").alias("was"), (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("y"))
        norm = y.agg(F.sqrt(F.sum(F.col("y") ** 2)).alias("norm"))
        return y.join(F.broadcast(norm)).select("node", (F.col("y") / F.col("norm")).alias("x"), "was", *keep)  # one row

    out = _until(start, step, tolerance, most)
    fixed.unpersist()
    dropped(both)
    return out.select("node", F.col("x").alias("centrality"))


def pagerank(graph: DataFrame, tolerance: float = 1e-10, most: int = 500, damping: float = 0.85) -> DataFrame:
    """Weighted; the mass of nodes without out-edges is shared by all. Rounds go on until one changes
    the ranks by less than tolerance in sum. An empty graph gives no rows."""
    out = graph.groupBy("src").agg(F.sum("weight").alias("total"))
    links = staged(graph.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "links")
    fixed = _fixed(links, "src")
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    loose = links.select(F.col("src").alias("node"), F.lit(False).alias("dangling")).distinct()
    nodes = nodes.join(loose, "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    start = staged(nodes.join(F.broadcast(n)).withColumn("x", 1.0 / F.col("n")), "round")  # one row

    def step(x: DataFrame, keep: list) -> DataFrame:
        into = fixed.join(x.select(F.col("node").alias("src"), "x"), "src").groupBy("dst").agg(F.sum(F.col("x") * F.col("p")).alias("s"))
        loose = x.agg(F.sum(F.when(F.col("dangling"), F.col("x")).otherwise(0.0)).alias("loose"))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("s", F.lit(0.0)) + F.col("loose") / F.col("n"))
        return x.join(into, F.col("node") == F.col("dst"), "left").join(F.broadcast(loose)).select("node", "dangling", "n", *keep, new.alias("new"), F.col("x").alias("was")).withColumnRenamed("new", "x")  # one row

    ranks = _until(start, step, tolerance, most)
    fixed.unpersist()
    dropped(links)
    return ranks.select("node", F.col("x").alias("rank"))


def net_leadership(graph: DataFrame) -> DataFrame:
    both = graph.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(graph.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    s = both.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return s.select("node", ((F.col("o") - F.col("i")) / (F.col("o") + F.col("i"))).alias("leadership"))


def network_payload(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of a network answer: kind node (a, sector, value = centrality) or edge (a, b, value)."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("ticker").alias("a"), F.coalesce("sector", F.lit("Unknown")).alias("b"), F.round("centrality", 4).alias("value"))
    return n.unionByName(graph.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("value")))


def nearest_price(prices: DataFrame, target: DataFrame, days: int = 7) -> DataFrame:
    """(ticker, past_date, past_close): the close nearest to target's one date, within so many days on
    either side; of two equally near the earlier."""
    gap = F.abs(F.datediff("date", F.col("__target")))
    near = prices.join(F.broadcast(target.toDF("__target"))).withColumn("gap", gap).where(F.col("gap") <= days)  # one row
    return near.groupBy("ticker").agg(F.min_by(F.struct("date", "close"), F.struct("gap", "date")).alias("p")).select("ticker", F.col("p.date").alias("past_date"), F.col("p.close").alias("past_close"))


def momentum(prices: DataFrame, back: int = 182, days: int = 7) -> DataFrame:
    """(ticker, momentum_return, momentum): the latest close over that of half a year before, and its
    average-rank percentile."""
    target = prices.agg(F.date_sub(F.max("date"), back).alias("d"))
    latest = prices.groupBy("ticker").agg(F.max_by("close", "date").alias("latest"))
    both = latest.join(nearest_price(prices, target, days), "ticker", "left").withColumn("momentum_return", F.round(F.try_divide("latest", "past_close") - 1 + 1e-12, 9))
    return average_rank_pct(both, "momentum_return", "momentum").select("ticker", "momentum_return", F.round(F.col("momentum") * 100 + 1e-9, 2).alias("momentum"))


def centrality_score(edges: DataFrame) -> DataFrame:
    nodes = average_rank_pct(node_centrality(edges).select("ticker", "centrality"), "centrality", "score")
    return nodes.select("ticker", F.round(F.col("score") * 100 + 1e-9, 2).alias("centrality"))


def quality_scores(meta: DataFrame, momentum: DataFrame, fundamental: DataFrame, centrality: DataFrame, vol: DataFrame) -> DataFrame:
    """metadata with every score that a ticker has."""
    return reduce(lambda a, b: a.join(b, "ticker", "left"), [momentum, fundamental, centrality, vol], meta)


def quality_picks(scores: DataFrame, held_sectors: DataFrame, holdings: DataFrame, limit: int = 10) -> DataFrame:
    """Weighted factors, of 0 to 100 each, without the holdings; the two strongest factors are named."""
    x = scores.join(holdings, "ticker", "left_anti").join(held_sectors.withColumn("has", F.lit(True)), "sector", "left")
    parts = {"momentum": (0.35, F.coalesce("momentum", F.lit(50.0))), "fundamental": (0.25, F.coalesce("fundamental", F.lit(50.0))), "diversity": (0.20, F.when(F.col("has"), 0.0).otherwise(100.0)), "volatility": (0.10, F.coalesce("vol_fit", F.lit(50.0))), "centrality": (0.10, F.coalesce("centrality", F.lit(0.0)))}
    score = sum((w * c for w, c in parts.values()), F.lit(0.0))
    best = F.array_sort(F.array(*[F.struct((-F.round(w * c, 6)).alias("v"), F.lit(k).alias("k")) for k, (w, c) in parts.items()]))
    return x.select("ticker", F.round(score + 1e-9, 4).alias("score"), F.concat_ws(" and ", best[0]["k"], best[1]["k"]).alias("why")).orderBy(F.desc("score"), "ticker").limit(limit)


def sector_breakdown(weights: DataFrame) -> DataFrame:
    g = weights.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return g.join(F.broadcast(g.agg(F.sum("weight").alias("__w")))).withColumn("share", F.col("weight") / F.col("__w")).drop("__w")  # one row


def candidate_pool(edges: DataFrame, holdings: DataFrame, ceiling: float, limit: int = 150) -> DataFrame:
    """Stocks weakly linked to at least half of the holdings, the least linked first."""
    least = holdings.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2)).alias("__least"))
    links = both_ends(edges.where(F.col("mean_dcor") <= ceiling)).join(holdings.select(F.col("ticker").alias("other")), "other", "left_semi").join(holdings, "ticker", "left_anti")
    g = links.groupBy("ticker").agg(F.count_distinct("other").alias("links"), F.avg("mean_dcor").alias("avg_dcor"), F.min("mean_dcor").alias("min_dcor"))
    return g.join(F.broadcast(least), F.col("links") >= F.col("__least")).drop("__least").orderBy(F.round("avg_dcor", 9), "ticker").limit(limit)  # one row


def pick_per_sector(candidates: DataFrame, *order: str, within: tuple = ()) -> DataFrame:
    """Of each known sector the candidate that comes first by the given columns, then by ticker; one for
    each value of the columns in within, if there are any."""
    by = F.struct(*[F.round(c, 9) for c in order], F.col("ticker"))
    keys = [*within, "sector"]
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.where("sector is not null and sector != 'Unknown'").groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("p")).select(*keys, "p.*")


def pairwise_distance(points: DataFrame, vector: str, key: str) -> DataFrame:
    """(a, b, dist) of a bounded candidate set, Euclidean, divided by the largest."""
    a, b = points.select(F.col(key).alias("a"), F.col(vector).alias("va")), points.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    d = a.join(b, F.col("a") != F.col("b")).select("a", "b", F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)).alias("dist"))
    return d.join(F.broadcast(d.agg(F.max("dist").alias("__m")))).select("a", "b", (F.col("dist") / F.col("__m")).alias("dist"))


def feature_matrix(links: DataFrame, features: list, sectors: list) -> DataFrame:
    """(ticker, features, a column sector_<name> a sector): the median of each feature over a stock's
    links, the median of the stocks where it has none, 0 where none has; its most frequent sector, one-hot."""
    per = links.groupBy("ticker").agg(*[F.percentile(c, 0.5).alias(c) for c in features], F.mode("sector", deterministic=True).alias("sector"))
    per = staged(per, "medians")
    middle = exact_quantiles(per, {c: F.col(c) for c in features}, (0.5,))
    filled = per.select("ticker", "sector", *[F.coalesce(c, F.lit(middle[c][0]).cast("double"), F.lit(0.0)).alias(c) for c in features])
    return filled.select("ticker", *features, *[F.coalesce((F.col("sector") == x).cast("double"), F.lit(0.0)).alias(f"sector_{x}") for x in sectors])


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))


def kmedoids(dist: DataFrame, ks: list, runs: int = 5, rounds: int = 5, seed: int = 0) -> DataFrame:
    """(k, point, medoid, inertia): for every k the run with the least inertia (sum of distances to the
    medoids). dist(a, b, dist) has all ordered pairs a != b of a bounded set of candidates.

    All k and runs go through the same steps side by side. The first medoid of a run has the least
    keyed hash; each further one is drawn with a chance in proportion to the squared distance to the
    nearest medoid so far: it has the least -ln(u) / d², u from the keyed hash. Then assignment and
    the choice of each cluster's middle alternate. Ties go to the smaller point."""
    dist = staged(dist.select("a", "b", "dist").unionByName(dist.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("dist"))), "distances")
    points = dist.where("a = b").select(F.col("a").alias("p"))
    tries = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("run")) for k in ks for r in range(runs)]))
    u = lambda step: (F.conv(F.substring(_hash(F.lit(seed), F.col("k"), F.col("run"), F.lit(step), F.col("p")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    every = staged(points.select("p", tries.alias("t")).select("t.*", "p"), "tries")  # as many rows as k, runs and candidates
    medoids = staged(every.groupBy("k", "run").agg(F.min_by("p", F.struct(u(1), "p")).alias("m")), "medoids")
    for step in range(2, max(ks) + 1):
        near = dist.join(medoids.where(F.col("k") >= step), F.col("b") == F.col("m")).groupBy("k", "run", F.col("a").alias("p")).agg(F.min("dist").alias("d")).where("d > 0")
        more = near.groupBy("k", "run").agg(F.min_by("p", F.struct(F.round(-F.log(u(step)) / (F.col("d") * F.col("d")), 9), "p")).alias("m"))
        medoids = staged(medoids.unionByName(more), "medoids", spent=(medoids,))

    def assigned():
        near = dist.join(medoids, F.col("b") == F.col("m")).groupBy("k", "run", F.col("a").alias("point"))
        return near.agg(F.min_by(F.struct("m", "dist"), F.struct(F.round("dist", 9), "m")).alias("n")).select("k", "run", "point", F.col("n.m").alias("medoid"), F.col("n.dist").alias("dist"))

    for _ in range(rounds):
        own = staged(assigned(), "assigned")
        x, y = own.select("k", "run", "medoid", F.col("point").alias("a")), own.select("k", "run", "medoid", F.col("point").alias("b"))
        inner = x.join(y, ["k", "run", "medoid"]).join(dist, ["a", "b"]).groupBy("k", "run", "medoid", "a").agg(F.sum("dist").alias("s"))
        middle = inner.groupBy("k", "run", "medoid").agg(F.min_by("a", F.struct(F.round("s", 9), "a")).alias("m")).select("k", "run", "m")
        medoids = staged(middle, "medoids", spent=(medoids, own))
    own = staged(assigned(), "assigned")
    total = own.groupBy("k", "run").agg(F.sum("dist").alias("inertia"))
    best = total.groupBy("k").agg(F.min_by(F.struct("run", "inertia"), F.struct(F.round("inertia", 9), "run")).alias("r")).select("k", "r.*")
    return staged(own.join(best, ["k", "run"]).select("k", "point", "medoid", "inertia"), "clusters", spent=(own, medoids, every))


def cluster_sweep(dist: DataFrame, clusters: DataFrame, min_size: int = 2, most: float = 0.5) -> DataFrame:
    """Per k of clusters(k, point, medoid, inertia): sizes, validity, whether a cluster is oversized,
    balance, and the silhouette of valid ones."""
    size = clusters.groupBy("k", "medoid").agg(F.count(F.lit(1)).alias("n"), F.max("inertia").alias("inertia"))
    per = size.groupBy("k").agg(F.max("inertia").alias("inertia"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("balance_cv"), F.sum("n").alias("points"))
    score = _silhouettes(dist, clusters.select("k", "point", F.col("medoid").alias("label")), ["k"]).groupBy("k").agg(F.avg("s").alias("silhouette"))
    per = per.join(score, "k").withColumn("valid", F.col("min_size") >= min_size).withColumn("oversized", F.col("max_size") > F.col("points") * most)
    return per.withColumn("silhouette", F.when(F.col("valid"), F.col("silhouette"))).drop("points")


def _silhouettes(dist: DataFrame, labels: DataFrame, keys: list) -> DataFrame:
    """(keys, point, s): (b - a) / max(a, b) of every point; 0 where it is alone."""
    x, y = labels.select(*keys, F.col("point").alias("a"), F.col("label").alias("la")), labels.select(*keys, F.col("point").alias("b"), F.col("label").alias("lb"))
    return scored_points(dist.join(x, "a").join(y, [*keys, "b"]).groupBy(*keys, "a", "la", "lb").agg(F.avg("dist").alias("d")), keys)


def scored_points(mean: DataFrame, keys: list) -> DataFrame:
    """(keys, point, s) from each point's mean distances to every label: mean(keys, a, la, lb, d)."""
    per = mean.groupBy(*keys, "a").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("other"))
    s = F.when(F.col("own").isNull(), 0.0).otherwise(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")))
    return per.select(*keys, F.col("a").alias("point"), s.alias("s"))


def intra_distances(dist: DataFrame, clusters: DataFrame) -> DataFrame:
    """(k, point, medoid, cluster_size, mean_intra_dist): of clusters(k, point, medoid, ...) each point's
    mean distance to all of its cluster, itself among them with 0."""
    x, y = (clusters.select("k", "medoid", F.col("point").alias(c)) for c in "ab")
    size = clusters.groupBy("k", "medoid").agg(F.count(F.lit(1)).alias("cluster_size"))
    total = x.join(y, ["k", "medoid"]).join(dist, ["a", "b"]).groupBy("k", F.col("a").alias("point")).agg(F.sum("dist").alias("s"))
    own = clusters.join(size, ["k", "medoid"]).join(total, ["k", "point"], "left")
    return own.select("k", "point", "medoid", "cluster_size", (F.coalesce("s", F.lit(0.0)) / F.col("cluster_size")).alias("mean_intra_dist"))


def elbow_k(sweep: DataFrame, sensitivity: float = 0.45) -> DataFrame:
    """One row k, over the valid rows of sweep(k, inertia, valid), a few: the larger of the k with the
    largest second difference of drops (never negative) and the first whose drop is under sensitivity
    of the drop before; with fewer than three, the first."""
    w = W.orderBy("k")
    d = sweep.where("valid").select("k", "inertia").withColumn("drop", F.greatest(F.col("inertia") - F.lead("inertia").over(w), F.lit(0.0)))
    d = d.withColumn("before", F.lag("drop").over(w))
    accel = F.max_by("k", F.when(F.col("before").isNotNull() & F.col("drop").isNotNull(), F.struct(F.round(F.col("before") - F.col("drop"), 9), -F.col("k"))))
    sense = F.min(F.when((F.col("before") > 0) & (F.col("drop") / F.col("before") < sensitivity), F.col("k")))
    return d.agg(F.when(F.count(F.lit(1)) < 3, F.min("k")).otherwise(F.greatest(accel, sense)).alias("k"))


def chosen_k(sweep: DataFrame, elbow: DataFrame, picks: DataFrame) -> DataFrame:
    """One row k: of the valid ones from the elbow on (or all, if none is) that with picks in most
    sectors, then the best silhouette, then the smallest; no row if none is valid. picks(k, sector, ...)
    has the picks of each k."""
    sectors = picks.groupBy("k").agg(F.count_distinct("sector").alias("sectors"))
    rows = sweep.where("valid").join(sectors, "k").join(F.broadcast(elbow.toDF("__elbow")))  # one row
    order = F.struct((F.col("k") >= F.col("__elbow")).alias("past"), "sectors", F.round("silhouette", 9).alias("s"), -F.col("k"))
    return rows.agg(F.max_by("k", order).alias("k")).where("k is not null")


def cluster_quality(picks: DataFrame, ceiling: float, min_sectors: int = 6) -> DataFrame:
    """One row: sectors, picks over the dCor ceiling, and whether every sector has one pick, there are
    enough sectors and no pick is over the ceiling."""
    over = F.count_if(F.col("avg_dcor") > ceiling)
    good = (F.count_distinct("sector") == F.count(F.lit(1))) & (F.count_distinct("sector") >= min_sectors) & (over == 0)
    return picks.agg(F.count_distinct("sector").alias("n_sectors"), over.alias("n_over"), good.alias("ok"))


def compare_picks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sector both sides' pick and the difference of their dCor."""
    x, y = a.select("sector", F.col("ticker").alias("ticker_a"), F.col("dcor").alias("da")), b.select("sector", F.col("ticker").alias("ticker_b"), F.col("dcor").alias("db"))
    return x.join(y, "sector", "full").select("sector", "ticker_a", "ticker_b", (F.col("db") - F.col("da")).alias("delta"))
