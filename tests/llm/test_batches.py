"""Batches of texts are bounded by their bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from lagweave.llm import quality


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word"), "id", F.lit(" ")), 1000).alias("text"))
    assert quality.keep_good(docs).count() == 0
    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) < 8 << 20
