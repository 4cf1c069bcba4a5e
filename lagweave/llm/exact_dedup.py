"""Exact copies by two passes over a Bloom filter.

Pass one reads every text's digest and makes a filter of the bits that were hit at least twice
(bloom.py: only bitmaps move, no record of a text does). Pass two tests every row: one that fails
has no copy anywhere and passes straight through; only the others shuffle, by their full digest,
for exact groups. The filter's size follows the number of rows up to a bound; beyond it more single
rows shuffle and no result changes.

Texts are equal when they are after each run of [\\x20\\x09-\\x0D] became one space. A null text
is an empty one. Of equal texts the row with the smallest doc_id stays; null doc_ids come last;
of rows that repeat a doc_id with equal text, one stays. An empty table gives an empty result.
Other columns are carried along and never looked at.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import SPACE_CLASS, dropped, staged, table


def text_digest(text: str = "text") -> Column:
    """Lower-case hex SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SPACE_CLASS}]+", " "), 256)


def exact_groups(docs: DataFrame, most_bits: int = bloom.MOST_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    digests = docs.select("doc_id", text_digest().alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    digests = staged(digests.withColumn("key", F.xxhash64("text_sha256")), "digests")
    maybe = bloom.passes(spark, bloom.repeated(digests, "key", most=most_bits), F.col("key"))
    tested = staged(digests.withColumn("maybe", maybe).drop("key"), "tested", spent=(digests,))
    single = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    left = tested.where("maybe").select("doc_id", "row", "text_sha256")
    groups = left.groupBy("text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = staged(groups, "groups")  # with a shuffle of its own, the join can split a hot group
    many = left.join(groups, "text_sha256").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    return single.unionByName(many)


def drop_copies(docs: DataFrame, most_bits: int = bloom.MOST_BITS) -> DataFrame:
    """docs without copies, all columns kept. Rows with no copy don't shuffle; of the others one
    row of each group leaves the map side, whatever the group's size."""
    spark, cols = docs.sparkSession, docs.columns
    keys = staged(docs.select(F.xxhash64(text_digest()).alias("key")), "digests")
    bits = bloom.repeated(keys, "key", most=most_bits)
    dropped(keys)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("r"), text_digest().alias("text_sha256"))
    tested = whole.withColumn("maybe", bloom.passes(spark, bits, F.xxhash64("text_sha256")))
    order = F.struct(F.col("r.doc_id").isNull(), F.col("r.doc_id"), F.xxhash64("r"))
    many = tested.where("maybe").groupBy("text_sha256").agg(F.min_by("r", order).alias("r"))
    return tested.where("not maybe").select("r.*").unionByName(many.select("r.*"))


def op5(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
