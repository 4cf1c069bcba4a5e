"""K-medoids of any number of points: swaps on samples, the whole set assigned once. The silhouette of
any labelling, from all pairs.

Each sample is a small problem of its own, solved in one task by swaps that keep every point's nearest
and second-nearest medoid, so a swap of any candidate is priced for all medoids in one pass over the
sample. The medoids found are then held against all points, which is one pass, and for each k those
with the least sum of distances win. Only medoids are broadcast: samples times the sum of ks rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import dropped, staged
from ..workers import prepared
from .network import scored_points

#: Points of a block, and of the part of one that is held against another block at a time.
BLOCK, PART = 16_384, 256
#: Points of a sample: so many, and so many more for each cluster.
SAMPLE, SAMPLE_PER_K = 200, 20


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0))


def swapped_medoids(d: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k medoids of points with distances d, from a spread-out start, by swaps until none helps."""
    n = len(d)
    k = min(k, n)
    medoids = [int(rng.integers(n))]
    while len(medoids) < k:
        near = d[:, medoids].min(axis=1) ** 2
        rest = np.setdiff1d(np.arange(n), medoids)
        chance = near[rest] if near[rest].sum() > 0 else np.ones(len(rest))
        medoids.append(int(rng.choice(rest, p=chance / chance.sum())))
    medoids, at, since = np.array(medoids), 0, 0
    if k == n:
        return medoids
    own = _nearest(d, medoids)
    while since < n:
        # the gain of candidate `at` in place of each medoid
        if at not in medoids:
            who, first, second = own
            new = d[:, at]
            shared = np.minimum(new - first, 0).sum()
            lost = np.bincount(who, weights=np.minimum(new, second) - first - np.minimum(new - first, 0), minlength=k)
            best = int(lost.argmin())
            if shared + lost[best] < -1e-12:
                medoids[best], since = at, 0
                own = _nearest(d, medoids)
        at, since = (at + 1) % n, since + 1
    return medoids


def _nearest(d: np.ndarray, medoids: np.ndarray):
    """(number of the nearest medoid, distance to it, distance to the second-nearest) of each point."""
    to = d[:, medoids]
    who = to.argmin(axis=1)
    first = to[np.arange(len(d)), who]
    if len(medoids) == 1:
        return who, first, np.full(len(d), np.inf if len(d) else 0.0)
    rest = to.copy()
    rest[np.arange(len(d)), who] = np.inf
    return who, first, rest.min(axis=1)


def sampled_kmedoids(points: DataFrame, vector: str, key: str, ks: list, samples: int = 5, seed: int = 0, sample: int = SAMPLE, per_k: int = SAMPLE_PER_K) -> DataFrame:
    """(k, point, medoid, dist, inertia) of points(key, vector of doubles), for every k the best of the
    samples. A sample has sample + per_k * max(ks) points on average, those with the least keyed
    hashes, or all if there are no more. Points without a vector are left out; no points, no rows."""
    spark = prepared(points.sparkSession)
    known = staged(points.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("point"), F.col(vector).cast("array<double>").alias("v")), "points")
    total = known.count()
    share = min(1.0, (sample + per_k * max(ks)) / max(total, 1))
    number = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    drawn = known.withColumn("sample", number).withColumn("u", F.xxhash64(F.lit(seed), "sample", F.col("point").cast("string")))
    drawn = drawn.where((F.pmod("u", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else F.lit(True))
    lists = drawn.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("point", "v"))).alias("s"))
    tries = lists.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).repartition(samples * len(ks), "sample", "k")
    kind = dict(known.dtypes)["point"]

    def solve(batches):
        for batch in batches:
            for r in range(len(batch)):
                s = batch.column("s")[r].values
                v, (number, k) = np.array(s.field("v").to_pylist(), float), (batch.column(c)[r].as_py() for c in ("sample", "k"))
                found = pa.array(np.sort(swapped_medoids(distances(v, v), k, np.random.default_rng([seed, number, k]))))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array([number] * len(found), pa.int32()), s.field("point").take(found), s.field("v").take(found)], ["k", "sample", "medoid", "v"])

    medoids = staged(tries.select("sample", "k", "s").mapInArrow(solve, f"k int, sample int, medoid {kind}, v array<double>"), "medoids")
    table = medoids.orderBy("k", "sample", "medoid").toArrow()  # samples * sum(ks) rows
    ids = list(zip(table["k"].to_pylist(), table["sample"].to_pylist()))
    shared = spark.sparkContext.broadcast((ids, np.array(table["v"].to_pylist(), float)))

    def assigned(batch, wanted=None):
        """(k, sample, numbers of the medoids, distances to the nearest, its number) for a batch."""
        ids, at = shared.value
        v = np.array(batch.column("v").to_pylist(), float)
        for group in dict.fromkeys(ids):
            if wanted is None or group in wanted:
                own = np.array([i for i, x in enumerate(ids) if x == group])
                to = distances(v, at[own])
                near = to.argmin(axis=1)
                yield group, own[near], to[np.arange(len(v)), near]

    def price(batches):
        for batch in batches:
            for start in range(0, len(batch), 4096):
                got = [(k, number, float(d.sum())) for (k, number), _, d in assigned(batch.slice(start, 4096))]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.float64())], ["k", "sample", "total"])

    sums = known.select("v").mapInArrow(price, "k int, sample int, total double").groupBy("k", "sample").agg(F.sum("total").alias("inertia")).collect()  # a row a try
    best = {}
    for r in sorted(sums, key=lambda r: (r.k, round(r.inertia, 9), r.sample)):
        best.setdefault(r.k, (r.sample, r.inertia))
    wanted = {(k, number) for k, (number, _) in best.items()}
    names = spark.sparkContext.broadcast(table["medoid"].combine_chunks())

    def assign(batches):
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                for (k, _), near, d in assigned(part, wanted):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.int32()), part.column("point"), names.value.take(pa.array(near)), pa.array(d), pa.array([best[k][1]] * len(part), pa.float64())], ["k", "point", "medoid", "dist", "inertia"])

    out = staged(known.mapInArrow(assign, f"k int, point {kind}, medoid {kind}, dist double, inertia double"), "clusters")
    dropped(known)
    dropped(medoids)
    return out


def paired_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all a to all b by a product of matrices; those that would be lost in its rounding
    are taken from the differences."""
    size = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    d = size - 2 * (a @ b.T)
    for at in np.array_split(np.flatnonzero((d <= 1e-6 * size).ravel()), 1 + d.size // 65_536):
        i, j = np.divmod(at, len(b))
        d[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(d, out=d)


def label_distances(points: DataFrame, vector: str, key: str, label: str, block: int = BLOCK) -> DataFrame:
    """(a, la, lb, d): the mean distance of every point a, labelled la, to the other points labelled lb.

    All pairs are looked at, which is quadratic; points are dealt out to blocks by hash and two blocks
    meet in one task, once for both directions. Their distances come from a product of matrices,
    part by part, and leave the task as sums, a row a point and label. Points without a vector or key don't
    count; a missing label is equal to none."""
    spark = prepared(points.sparkSession)
    known = points.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("a"), F.col(label).alias("la"), F.col(vector).alias("v"))
    known = staged(known, "points")
    total, tasks = known.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # no larger than a block, and cells for all tasks unless there are few points
    blocks = max(-(-total // block), min(-(-total // 512), int(np.ceil(np.sqrt(6 * tasks)))), 1)
    dealt = known.withColumn("own", F.pmod(F.xxhash64("a"), F.lit(blocks))).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("a", "la", "v", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        point, name, v = (table[c].combine_chunks() for c in ("a", "la", "v"))
        v = np.array(v.flatten(), float).reshape(len(v), -1)
        named, own = name.dictionary_encode(null_encoding="encode"), np.asarray(table["own"])
        code = np.asarray(named.indices)
        left, right = (x[np.argsort(code[x], kind="stable")] for x in (np.flatnonzero(own == k.as_py()) for k in key))
        if not (len(left) and len(right)):
            return

        def rows(of, labels, sums):
            at = pa.array(np.repeat(of, len(labels)))
            return pa.RecordBatch.from_arrays([point.take(at), name.take(at), named.dictionary.take(pa.array(np.tile(labels, len(of)))), pa.array(sums.ravel())], ["a", "la", "lb", "s"])

        theirs, first = np.unique(code[right], return_index=True)
        last, back = None, None  # the label that the next part may go on with, its sums
        for start in range(0, len(left), PART):
            part = left[start : start + PART]
            d = paired_distances(v[part], v[right])
            yield rows(part, theirs, np.add.reduceat(d, first, axis=1))
            if key[0] == key[1]:
                continue  # a block with itself has both directions
            labels, at = np.unique(code[part], return_index=True)
            sums = np.add.reduceat(d, at, axis=0)
            if labels[0] == last:
                sums[0] += back
            elif last is not None:
                yield rows(right, [last], back)
            if len(labels) > 1:
                yield rows(right, labels[:-1], sums[:-1].T)
            last, back = labels[-1], sums[-1]
        if last is not None:
            yield rows(right, [last], back)

    kind = dict(known.dtypes)
    cells = blocks * (blocks + 1) // 2
    sums = dealt.repartition(cells, "i", "j").groupBy("i", "j").applyInArrow(meet, f"a {kind['a']}, la {kind['la']}, lb {kind['la']}, s double")
    sums = sums.groupBy("a", "la", "lb").agg(F.sum("s").alias("s"))
    sizes = known.groupBy(F.col("la").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    others = F.col("n") - F.when(F.col("la") == F.col("lb"), 1).otherwise(0)
    out = sums.join(sizes, F.col("lb").eqNullSafe(F.col("of"))).where(others > 0)
    return out.select("a", "la", "lb", (F.col("s") / others).alias("d"))


def silhouette(points: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """Mean silhouette of one labelling over all pairs of points, with sizes. A point without a vector
    scores 0, as one that is alone does."""
    size = points.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("min_size"), F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("balance_cv"), F.count(F.lit(1)).alias("k"))
    bare = points.where(F.col(vector).isNull() & F.col(key).isNotNull()).select(F.lit(0.0).alias("s"))
    scores = scored_points(label_distances(points, vector, key, label), []).select("s").unionByName(bare)
    return scores.agg(F.avg("s").alias("silhouette")).join(size)  # one row each
