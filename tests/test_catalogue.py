import oracle
import pytest

from foliant.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_oracle(spark, sf_dir, name):
    assert oracle.compare(spark, QUERIES[name], SQL[name], sf_dir) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["page_id", "number", "title", "url"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
