"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from tagweave.plans import QUERIES, SQL
from tests.harness import both


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    got, want = both(spark, sf, QUERIES[name], SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.collect() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).collect()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
