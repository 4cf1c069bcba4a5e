"""Token shards that are written in waves."""

import time
import uuid

import pytest

from lagweave.llm import bpe, token_shards


def shuffles(spark):
    """Shuffle files that are on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"text {i} " * (i % 90)) for i in range(300)] + [(300, None)], "doc_id long, text string").repartition(3).localCheckpoint()


def written(docs, **options):
    folder = f"/tmp/spark-waves-{uuid.uuid4().hex}"
    manifest = token_shards.write_order(docs, folder, bpe.default_vocabulary(), length=32, rows=64, **options)
    slots = {r.slot: bytes(r.ids) for r in token_shards.read_order(manifest, folder, bpe.default_vocabulary(), length=32).collect()}
    return sorted(map(tuple, manifest.collect())), slots


def test_no_shuffle_is_left_of_a_wave(spark, docs):
    before = shuffles(spark)
    token_shards.write_order(docs, f"/tmp/spark-waves-{uuid.uuid4().hex}", bpe.default_vocabulary(), length=32, rows=64)
    for _ in range(50):
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.2)
    assert not left


def test_waves_give_the_same_shards(docs):
    whole, slots = written(docs, waves=1)
    assert len(whole) > 5 and sorted(slots) == list(range(len(slots)))
    for waves in (2, 3, 1000):
        assert written(docs, waves=waves) == (whole, slots)
