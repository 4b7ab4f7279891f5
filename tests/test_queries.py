"""Every registered query gives the rows of its SQL twin."""

import pytest

import __spark_entry__ as entry

from .compare import compare, duck

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    ok, message = compare(spark, SF, name, entry.queries()[name], SQL.get(name), connection)
    assert ok, message


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["total"] >= rows[-1]["total"]


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry.queries())
