"""Every query of the core with a statement gives the statement's rows on the smallest tables."""

import pytest

from skein import catalogue
from tests.compare import both

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_statement(spark, small, name):
    got, want = both(spark, small, catalogue.queries()[name], SQL[name])
    assert got == want


def test_entry_and_names(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
