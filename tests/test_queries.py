import pytest
from oracle import same

from logloom.plans import general, ingestion, retrieval

SQL = {n: (plan.queries()[n], sql) for plan in (general, retrieval, ingestion) for n, sql in plan.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_its_sql(spark, sf, name):
    assert same(spark, sf, *SQL[name]) >= 0
