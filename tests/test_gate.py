"""Every registered query against its SQL, on the smallest data."""

import pytest

from __spark_entry__ import oracle_sql, queries
from compare import compare, connection
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert ok, note
