import pytest
from oracle import DATA, assert_same

from talewind.plans import catalog, records
from talewind.sources import tables

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(SQL) - {"isolated_nodes"}))
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_works_without_the_optional_folders(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_isolated_nodes(spark, monkeypatch):
    """The tables leave no node isolated; with the strong and medium relations alone some are."""
    assert QUERIES["isolated_nodes"](spark, DATA).count() == 0
    monkeypatch.setattr(records, "edges", lambda spark, d: tables.edges(spark, d).filter("strength >= 2"))
    assert_same(QUERIES["isolated_nodes"](spark, DATA), SQL["isolated_nodes"].replace("nxt IS NOT NULL GROUP", "nxt IS NOT NULL AND l_quantity >= 49 GROUP"))
