"""Every registered query against its oracle on the smallest data."""

import pytest

import __spark_entry__ as contract
from ledgerloom.plans import catalog
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    problem, _, _ = compare(spark, con, SF, QUERIES[name], ORACLE.get(name))
    assert problem is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["chain_id", "token", "address", "balance"]
    assert rows.count() > 0
