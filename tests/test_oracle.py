import pytest
from conftest import DATA
from oracle import connect, difference

from tarnlight.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, DATA), con, ORACLE[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
