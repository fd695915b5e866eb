import pytest
from oracle import same

from logloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_its_sql(spark, sf, name):
    assert same(spark, sf, queries.queries()[name], SQL[name]) > 0
