import pytest

from oracle import of_spark, of_sql
from textward import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    assert of_spark(catalog.queries()[name](spark, sf)) == of_sql(SQL[name], sf)
