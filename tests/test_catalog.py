"""Every query against DuckDB, over whole tables."""

import pytest

from docloom.plans import searches as catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(name, spark, folder):
    assert catalog.QUERIES[name](spark, folder).count() >= 0
