"""Queries of the operators against their SQL, on the smallest tables."""

import pytest

from tagweave.llm.queries import QUERIES, SQL
from tests.harness import both


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    got, want = both(spark, sf, QUERIES[name], SQL[name])
    assert got == want
