"""Every registered query with SQL gives the rows DuckDB gives."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    ok, message, _ = compare(spark, connection, FOLDER, name)
    assert ok, message
    assert "TYPES" not in message, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 12
