"""The silhouette from blocks against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from lagweave.operators import clusters


def plain(rows):
    """Mean silhouette by loops; labels of None are equal to none."""
    scores = []
    for i, (_, v, a) in enumerate(rows):
        by = {}
        for j, (_, w, b) in enumerate(rows):
            if i != j and v is not None and w is not None:
                by.setdefault(b, []).append(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())))
        own = np.mean(by[a]) if a is not None and a in by else None
        others = [np.mean(d) for b, d in by.items() if None not in (a, b) and b != a]
        scores.append(0.0 if own is None else None if not others else (min(others) - own) / max(own, min(others)))
    return float(np.mean([s for s in scores if s is not None]))


def test_silhouette_of_blocks_is_that_of_all_pairs(spark):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=5) + 3 * (i % 4)).tolist(), i % 4) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(60)]  # copies
    rows += [(400, [9.0] * 5, 7), (401, None, 1), (402, [1.0] * 5, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = clusters.silhouette(df, "v", "id", "label").first()
    assert abs(got.silhouette - plain(rows)) < 1e-9
    assert got.min_size == 1 and got.k == 6
    # blocks of few points, so that labels and copies cross them
    means = {(r.a, r.lb): r.d for r in clusters.label_distances(df, "v", "id", "label", block=20).collect()}
    want = {(r.a, r.lb): r.d for r in clusters.label_distances(df, "v", "id", "label", block=10_000).collect()}
    assert means.keys() == want.keys() and all(abs(means[k] - want[k]) < 1e-9 for k in want)


def test_pairs_of_points_never_become_rows(spark):
    df = spark.range(3000).select("id", F.array(*[F.rand(k) for k in range(4)]).alias("v"), (F.col("id") % 3).cast("int").alias("label"))
    sums = clusters.label_distances(df, "v", "id", "label")
    assert sums.count() == 9000
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_distances_of_near_copies_keep_their_digits():
    a = np.full((3, 8), 1000.0)
    b = a + np.array([0.0, 1e-6, 1e-3])[:, None]
    assert np.allclose(clusters.paired_distances(a, b)[0], np.array([0.0, 1e-6, 1e-3]) * np.sqrt(8), rtol=1e-6, atol=0)
