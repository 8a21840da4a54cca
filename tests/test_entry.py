"""Every registered query against its SQL on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_entry_returns_the_sources(spark):
    result = entry.entry(spark)
    assert result.columns == ["source_system", "monthly_rows", "total_consumption", "total_readings"]
    assert result.count() == 3


def test_every_query_has_sql():
    assert {name for name in entry.queries() if not name.startswith("op") and name != "pipeline"} <= set(ORACLES)
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    statement = duck.execute(ORACLES[name])
    order = [column[0] for column in statement.description]
    assert sorted(order) == sorted(df.columns)
    expected = statement.fetchall()
    assert sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in order]).collect()))) == sorted(map(repr, expected))
