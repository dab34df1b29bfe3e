"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, duck_table, spark_table
from tidebook.plans import catalog

ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, small, duck, name):
    found = spark_table(entry.queries()[name](spark, small))
    expected = duck_table(duck, ORACLES[name])
    assert found[0] == expected[0]
    assert len(found[1]) == len(expected[1])
    assert found[1] == expected[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(catalog.QUERIES)
    assert set(ORACLES) <= set(entry.oracle_sql()) and set(catalog.QUERIES) <= set(entry.queries())
