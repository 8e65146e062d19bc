import pytest
from oracle import assert_same

from foliant import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    assert_same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    rows = catalog.queries()[name](spark, sf).collect()
    assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
