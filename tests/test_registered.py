"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(duck, sql, df) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
