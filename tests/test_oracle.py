"""Every core query with SQL beside it, against DuckDB on the smallest tables."""

import pytest
from compare import DATA, difference

from reviewloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    d = f"{DATA}/sf0.001"
    assert difference(catalog.QUERIES[name](spark, d), catalog.ORACLE_SQL[name], d) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, f"{DATA}/sf0.001").count() >= 0
