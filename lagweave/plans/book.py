"""Registers queries: a name, its columns, a function of tables, and SQL for the oracle."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import surrogates


class Tables:
    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return surrogates.get(self.spark, self.sf_dir, name)


class Book:
    """cols names the result's columns, doubles with :d. Doubles are rounded alike on both sides."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, cols: str, make: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        fields = [c.partition(":") for c in cols.split()]

        def query(spark, sf_dir: str) -> DataFrame:
            df = make(Tables(spark, sf_dir))
            return df.select(*[F.round(F.col(c).cast("double") + 1e-9, 6).alias(c) if kind == "d" else F.col(c) for c, _, kind in fields])

        self.queries[name] = query
        if sql:
            outer = ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, 6) AS {c}" if kind == "d" else c for c, _, kind in fields)
            self.sql[name] = surrogates.oracle(f"SELECT {outer} FROM ({sql}) AS result")
