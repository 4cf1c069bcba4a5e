"""documents from raw to tokens: quality rules, exact dedup, near dedup, mixing, BPE.

All but the last stage return rows of documents with all their columns. Mixing repeats a row as
often as it is served. A null, empty or very long text, ties and repeated rows are treated as the
operators' docstrings say; an empty table goes through as one.
"""

import uuid

from pyspark.sql import DataFrame

from lagweave.llm import bpe, exact_dedup, mixing, ngram_join, quality
from lagweave.staging import removed
from lagweave.workers import prepared, shared_dir


def _quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def _exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def _near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def _mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def _tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, bpe.default_vocabulary())


STAGES = [("quality_rules", _quality), ("exact_dedup", _exact), ("ngram_join", _near), ("mixing", _mix), ("bpe", _tokens)]

ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet to the shared folder and read again by the next;
    what a stage has read is deleted then."""
    docs, before = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
