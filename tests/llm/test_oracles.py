"""Queries of the training-data operators against their SQL."""

from __future__ import annotations

import pytest

from oracle import same
from sheaf.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    same(spark, queries.queries()[name], SQL[name])
