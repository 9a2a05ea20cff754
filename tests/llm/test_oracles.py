"""The queries that SQL can express, against DuckDB on the smallest data."""

import pytest

from ledgerloom.llm import queries as llm
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_oracle(spark, name):
    problem, _, _ = compare(spark, duck(SF), SF, llm.queries()[name], llm.oracle_sql()[name])
    assert problem is None


def test_one_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))
