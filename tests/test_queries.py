"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from verdikt.plans import registry

SF_DIR = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) <= set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 14
