import pytest
from oracle import connect, same

from folio.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(name, spark, sf, duck):
    same(QUERIES[name](spark, sf), SQL[name], duck)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
