"""Tables staged in the cluster's shared folder: lineage ends there, and any executor can read them."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from .workers import shared_dir


#: Rows of a small table that one task writes.
ROWS_A_FILE = 250_000


def staged(df: DataFrame, tag: str, spent: tuple = (), rows: int | None = None, compression: str = "snappy") -> DataFrame:
    """df, written once to the shared folder and read back: later jobs, and tasks run again
    after an executor is lost, all see the same rows. Staged tables in spent are deleted then, and what is
    left of any when the application ends. Where
    the most rows that df can have are known, it is written in as many files as they ask for."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)).write.option("compression", compression).parquet(path)
    for old in spent:
        dropped(old)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)  # what nobody has dropped by then
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    removed(df.sparkSession, df._staged_at)
