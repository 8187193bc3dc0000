"""Every registered query: against its SQL where it has some, else that it gives rows."""

import pytest

from folioframe import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, same):
    same(catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_rows(name, spark, sf):
    assert catalogue.queries()[name](spark, sf).count() > (0 if name != "html_tables" else -1)  # the pages hold no tables


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
