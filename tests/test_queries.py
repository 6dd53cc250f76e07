import pytest

from pactlake.jobs import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(agree, name):
    agree(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
