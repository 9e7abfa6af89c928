"""Every registered query with SQL gives DuckDB's rows."""

import pytest

from callmetrics.plans import catalog

from .conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    same_as_sql(spark, catalog.QUERIES[name], catalog.SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
