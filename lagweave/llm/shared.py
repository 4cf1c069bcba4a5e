"""What the operators share: words, and what they use of staging and workers."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workers
from ..staging import dropped, removed, staged  # noqa: F401
from ..workers import shared_dir  # noqa: F401

#: A word is a run of other characters than these (regular-expression class body).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

#: Bytes of an Arrow batch, about: a task holds several at once, in Python and outside the JVM's heap.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with this package on its workers' path and, where it doesn't say how large Arrow
    batches are, small ones: whole texts are in them."""
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return workers.prepared(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str = "text"):
    """Words of a text column as a long; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """The session's setting has that value for what runs inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int):
    """For what runs inside, Arrow batches of so many rows at most: for rows of many kilobytes."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_deleted(spark: SparkSession):
    """For what runs inside, a query's shuffle files are deleted when it ends, and not when the driver
    happens to collect garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
