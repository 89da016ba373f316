"""Every registered query against its SQL, on the smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry
from driftspark.workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, name) is None


def test_entry(spark):
    assert entry.entry(spark).columns[:4] == ["kind", "schema", "name", "signature"]
