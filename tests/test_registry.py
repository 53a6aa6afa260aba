"""Every query of the library's own operators against its SQL."""

import pytest

from siltstone.plans import registry
from tests.oracle import check

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tiny, name):
    check(QUERIES[name](spark, tiny), SQL[name], tiny)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
