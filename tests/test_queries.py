import pytest

from fleetgrain.plans import catalog

from .compare import agree


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    agree(catalog.QUERIES[name](spark, small), catalog.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_have_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
