"""Stored tables that change by commits: readers see the table before or after one, never between.

A table's folder has data folders, which are never changed, and numbered manifests: small files that
name for each bucket of rows the folders that hold it. A change writes the buckets it touches anew and
then the next manifest, which appears by one rename. A writer that dies leaves files that no manifest
names. A writer that finds the next number taken starts again from the newest manifest if that has
changed a bucket that it touched, and otherwise commits on top of it, so that nothing is lost.

A bucket is the value of an SQL expression, such as a window's date or a hash of the key, with as many
values as a table has partitions; what reaches the driver is a line each. Beside each data folder lie
its marks, a row a key with its newest date, so high-water marks are read without the table. The
rename must fail if its target exists, as those of HDFS and local files do.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import removed
from .scans import keyed_update, merge_rows, newer_rows

BUCKET = "__bucket"


@dataclass
class Manifest:
    version: int
    schema: str
    by: str
    key: str | None = None
    date: str | None = None
    parts: dict[str, list[str]] = field(default_factory=dict)


class Conflict(Exception):
    """Others kept committing to the same buckets."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, by: str, key: str | None = None, date: str | None = None) -> "SnapshotTable":
        """A new table of rows; by is the SQL expression of the bucket. With key and date, marks are kept."""
        out = cls(rows.sparkSession, path)
        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        first = Manifest(0, schema, by, key, date)
        first.parts = out._written(rows, first)
        if not out._commit(first):
            raise FileExistsError(path)
        return out

    # --- manifests

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, folder: str) -> list[str]:
        fs, where = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def manifest(self) -> Manifest:
        """The newest one."""
        names = [n for n in self._folders(f"{self.path}/_manifests") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            raise FileNotFoundError(self.path)
        return Manifest(**json.loads(self.spark.read.text(f"{self.path}/_manifests/{max(names)}", wholetext=True).first()[0]))

    def _commit(self, new: Manifest) -> bool:
        """Whether new is now the manifest of its number; not if another has taken it."""
        fs, folder = self._fs(), f"{self.path}/_manifests"
        draft, there = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{new.version:012d}.json")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(asdict(new)).encode()))
        stream.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, there, none)
            return True
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or fs.exists(there):
                return False
            raise

    # --- data

    def _bucket(self, m: Manifest):
        return F.coalesce(F.expr(m.by).cast("string"), F.lit("none"))

    def _written(self, rows: DataFrame, m: Manifest) -> dict[str, list[str]]:
        """The buckets of rows, written to a new folder, with its marks."""
        name = f"data-{uuid.uuid4().hex}"
        where = f"{self.path}/{name}"
        # large buckets are split over tasks by AQE, small ones are a file each
        rows.withColumn(BUCKET, self._bucket(m)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(where)
        found = [n for n in self._folders(where) if n.startswith(f"{BUCKET}=")]
        if m.key and m.date and found:
            back = self.spark.read.schema(f"{m.schema}, {BUCKET} string").parquet(where)
            back.groupBy(BUCKET, m.key).agg(F.max(m.date).alias(m.date)).write.partitionBy(BUCKET).parquet(f"{where}-marks")
        return {n.partition("=")[2]: [f"{name}/{n}"] for n in found}

    def _read(self, m: Manifest, buckets=None) -> DataFrame:
        paths = [f"{self.path}/{p}" for b, parts in m.parts.items() if buckets is None or b in buckets for p in parts]
        return self.spark.read.schema(m.schema).parquet(*paths) if paths else self.spark.createDataFrame([], m.schema)

    def read(self, buckets=None) -> DataFrame:
        """The table, or only some buckets of it, as the newest manifest has it."""
        return self._read(self.manifest(), buckets)

    def latest_dates(self) -> DataFrame:
        """(key, last_date) from the marks: no file of the table itself is read."""
        m = self.manifest()
        paths = [f"{self.path}/{p.replace('/', '-marks/', 1)}" for parts in m.parts.values() for p in parts]
        kind = dict(self.spark.createDataFrame([], m.schema).dtypes)
        schema = f"`{m.key}` {kind[m.key]}, `{m.date}` {kind[m.date]}"
        marks = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return marks.groupBy(m.key).agg(F.max(m.date).alias("last_date"))

    # --- changes

    def rewrite(self, change: Callable[[DataFrame], DataFrame], touched=None, attempts: int = 10) -> int:
        """Puts change(rows) in the place of the rows of the touched buckets, all if none are named, and
        returns the version. change may only make rows of those buckets."""
        m = self.manifest()
        for _ in range(attempts):
            mine = set(m.parts if touched is None else touched)
            new = self._written(change(self._read(m, mine)), m)
            while True:
                now = self.manifest()
                others = set(now.parts) | set(m.parts) if touched is None else mine
                if any(now.parts.get(b) != m.parts.get(b) for b in others):
                    break  # what was read is no longer there
                parts = {b: p for b, p in now.parts.items() if b not in mine} | new
                if self._commit(Manifest(now.version + 1, m.schema, m.by, m.key, m.date, parts)):
                    return now.version + 1
            self._discard(new)
            m = now
        raise Conflict(self.path)

    def _discard(self, parts: dict[str, list[str]]) -> None:
        for folder in {p.split("/")[0] for some in parts.values() for p in some}:
            removed(self.spark, f"{self.path}/{folder}")
            removed(self.spark, f"{self.path}/{folder}-marks")

    def _of(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(self._bucket(self.manifest()).alias("b")).distinct().collect()]  # buckets

    def append(self, rows: DataFrame) -> int:
        """Adds rows; appends don't conflict with anything."""
        new = self._written(rows, self.manifest())
        while True:
            m = self.manifest()
            parts = m.parts | {b: m.parts.get(b, []) + p for b, p in new.items()}
            if self._commit(Manifest(m.version + 1, m.schema, m.by, m.key, m.date, parts)):
                return m.version + 1

    def merge(self, rows: DataFrame, keys: list) -> int:
        """Update all, insert missing, by keys that fix the bucket: only its buckets are written."""
        return self.rewrite(lambda old: merge_rows(old, rows, keys), self._of(rows))

    def update(self, rows: DataFrame, keys: list, column: str) -> int:
        """Sets a column from rows where the keys match; keys fix the bucket."""
        return self.rewrite(lambda old: keyed_update(old, rows, keys, column), self._of(rows))

    def replace(self, rows: DataFrame, buckets=None) -> int:
        """Puts rows in the place of their buckets, and of those that are named besides."""
        return self.rewrite(lambda old: rows, [*self._of(rows), *(buckets or [])])

    def delete(self, condition: str) -> int:
        """Takes rows out; buckets without such rows stay as they are."""
        return self.rewrite(lambda old: old.where(f"NOT coalesce({condition}, false)"), self._of(self.read().where(condition)))

    def append_new(self, rows: DataFrame) -> int:
        """Appends rows newer than their key's newest stored one, and all of unknown keys."""
        m = self.manifest()
        return self.append(newer_rows(rows, self.latest_dates(), m.key, m.date))

    def clean(self) -> None:
        """Deletes folders that the newest manifest doesn't name: of old versions and dead writers. For
        a time when nothing reads or writes the table."""
        named = {p.split("/")[0] for parts in self.manifest().parts.values() for p in parts}
        for name in self._folders(self.path):
            if name.startswith("data-") and name.removesuffix("-marks") not in named:
                removed(self.spark, f"{self.path}/{name}")
