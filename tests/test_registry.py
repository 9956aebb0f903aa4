"""Every registered query has SQL and agrees with DuckDB."""

import pytest

from marginalia.plans import registry
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
WITH_SQL = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(spark, db, name):
    assert_same(registry.queries()[name](spark, SF), db, registry.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(WITH_SQL) == set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
