"""Numbered queries that SQL can express, on the smallest tables."""

import os

import pytest

from folioscope.llm.queries import ORACLES, QUERIES
from tests.compare import DATA, database, rows_by_sql, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_by_sql(database(), ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
