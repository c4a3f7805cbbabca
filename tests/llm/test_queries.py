"""Queries of the subpackage that SQL can express, against that SQL."""

import pytest

from textveil.llm import queries

from ..oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
