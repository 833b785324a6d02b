"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as registered
from verification.check import connect, difference
from verification.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, connection, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert difference(frame, connection, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES) <= set(registered.queries())
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_has_rows(spark):
    assert registered.entry(spark).count() == 7
