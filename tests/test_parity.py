"""Every registered query against its oracle on whole tables."""

import pytest
from parity import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_oracle(spark, con, sf_dir, name):
    problem = compare(spark, con, sf_dir, QUERIES[name], SQL[name])
    assert problem is None or problem == "both empty", problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
