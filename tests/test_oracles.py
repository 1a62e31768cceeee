import pytest

from loomnote.plans import registry

from .conftest import SF
from .oracle import differences


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert not differences(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_rows_only_queries(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
