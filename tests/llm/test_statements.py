import pytest

from skein.llm import queries
from tests.compare import both

SQL = queries.oracle_sql()
#: Statements that compare all pairs of texts: on the smallest tables here.
PAIRS = {"p1_found", "p6_found"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_statement(spark, name):
    got, want = both(spark, f"/root/testdata/sf0.0{'0' * (name in PAIRS)}1", queries.queries()[name], SQL[name])
    assert got == want


def test_every_problem_has_queries():
    assert {f"p{n}_found" for n in range(1, 11)} <= set(queries.queries())
