"""Every catalogue query against its SQL. SPANMILL_TEST_SF chooses the table size."""

import os
from pathlib import Path

import pytest
from oracle import connect, differences

from spanmill.plans import catalog

SF_DIR = Path("/root/testdata") / f"sf{os.environ.get('SPANMILL_TEST_SF', '0.001')}"
QUERIES, ORACLES = catalog.queries(), catalog.oracles()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = connect(str(SF_DIR))
    yield connection
    connection.close()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, con, key):
    assert differences(QUERIES[key](spark, str(SF_DIR)), con, ORACLES[key]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["model", "cost", "unpriced_spans"]
