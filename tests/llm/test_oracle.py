"""Queries that have SQL give the same rows as DuckDB; all queries run on the smallest tables."""

import pytest

from amperflow.llm.queries import ORACLES, QUERIES

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
