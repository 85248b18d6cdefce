"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    same, note = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert same, note


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
