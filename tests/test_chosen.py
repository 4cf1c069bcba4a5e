"""The chosen number of clusters where none is valid."""

from pyspark.sql import functions as F

from lagweave.operators import network


def test_no_valid_number_of_clusters_is_no_row(spark):
    sweep = spark.createDataFrame([(3, 5.0, False, None), (4, 4.0, False, None)], "k int, inertia double, valid boolean, silhouette double")
    picks = spark.createDataFrame([(3, "ASIA", "a"), (4, "ASIA", "a")], "k int, sector string, ticker string")
    assert network.chosen_k(sweep, network.elbow_k(sweep), picks).count() == 0
    good = sweep.withColumn("valid", F.lit(True)).withColumn("silhouette", F.lit(0.5))
    assert [r.k for r in network.chosen_k(good, network.elbow_k(good), picks).collect()] == [3]
