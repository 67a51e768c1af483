"""Every named query against its SQL on the smallest data."""
import pytest

import __spark_entry__ as entry
from check import compare, connect

from tallybook.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()
SQL = registry.SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    rows, same, note = compare(spark, con, registry.QUERIES[name], SQL.get(name), SF)
    assert same is not False, note
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
