"""Makes this package importable for Python workers, and names the folder that a cluster shares."""

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set = set()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so have the same folders."""
    return spark.sparkContext.master.split("[")[0] == "local"


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with this package on its workers' path: by the path of this copy in local mode,
    on a cluster as an archive that Spark sends to every executor, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return spark
    if is_local(spark):
        env = sc.environment
        env["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), env.get("PYTHONPATH", "")) if x)
    else:
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{ROOT.name}-lagweave", "zip", ROOT, "lagweave")
        sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only in local mode, where it is unset in tests, a new
    one in /tmp takes its place; on a cluster every executor would see a folder of its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not (there := spark.sparkContext.getCheckpointDir()):
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")
