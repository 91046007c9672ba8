"""Every SQL-checked query equals its DuckDB oracle at sf0.001 (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_harness import compare, duck_conn

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.sql(SQL[name]).df()
    ok, msg = compare(sp, dk)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert {"campaign_id", "wins", "median_price"} <= set(df.columns)
