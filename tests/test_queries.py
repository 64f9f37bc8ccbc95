"""Every query of the library against its SQL, on the smallest tables."""

import os

import pytest

from folioscope.plans.catalog import ORACLES, QUERIES
from tests.compare import DATA, database, rows_by_sql, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    names, rows = rows_of(QUERIES[name](spark, DATA))
    if name in ORACLES:
        assert (names, rows) == rows_by_sql(con, ORACLES[name])
    else:
        assert sum(rows.values()) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
