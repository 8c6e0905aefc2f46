"""Every query of the reference's operators, against its SQL; those without SQL must give rows."""

from __future__ import annotations

import pytest

from oracle import SF, same
from sheaf.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()
