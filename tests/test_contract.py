import pytest

import __spark_entry__ as se
from tests.check_oracle import compare, duck

ORACLES = se.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(se.queries())


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, con, name):
    assert compare(se.queries()[name](spark, small), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_ends_under_a_limit(con, name):
    """A reader may wrap the SQL and take a few rows only; that must not change the plan for the worse."""
    assert len(con.execute(f"SELECT * FROM ({ORACLES[name]}) LIMIT 10").fetchall()) <= 10


def test_entry(spark):
    rows = se.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["classifier"] == "RFOREST"
