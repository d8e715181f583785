import pytest

from marlstone.plans import registry

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, sf, name):
    found = registry.queries()[name](spark, sf).cache()
    assert found.limit(1).count() == 1  # equal to nothing proves nothing
    assert_same(found, registry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
