"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as contract
from check_queries import compare, database
from conftest import FOLDER

CHECKED = sorted(set(contract.queries()) & set(contract.oracle_sql()))


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, connection, name):
    problem, _, _ = compare(spark, connection, FOLDER, name)
    assert problem in ("", "no rows on either side")


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 8
