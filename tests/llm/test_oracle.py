"""Training-data queries against their SQL."""

import pytest
from check import compare, connect

from replylens.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], ORACLE_SQL[name], sf) == ""


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
