"""Every registered query runs on the smallest tables, and SQL agrees where it can say the query."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check_oracles import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    got = df.collect()
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, result.fetchall())
