"""Every query that has SQL agrees with DuckDB; every other one runs."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(SQL[name])
    want = normal([d[0] for d in result.description], result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, FOLDER).count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
