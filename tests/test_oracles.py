"""All queries that have SQL against it in DuckDB, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from lagweave import catalog

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x.date() if isinstance(x, datetime.datetime) else x


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.execute("SET memory_limit = '4GB'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([plain(x) for x in r]) for r in oracle.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]}) AS q").fetchall())
    assert mine == theirs


def test_every_sql_belongs_to_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 150
