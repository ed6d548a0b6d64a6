import pytest

from tallywork.plans import registry

from .conftest import DATA
from .oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
