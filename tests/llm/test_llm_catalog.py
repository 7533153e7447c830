"""The queries against their SQL, and the pipeline."""

import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from oracle import connect, differences  # noqa: E402

import corpus_pipeline  # noqa: E402
from spanmill.llm import catalog  # noqa: E402

SF_DIR = Path("/root/testdata") / f"sf{os.environ.get('SPANMILL_TEST_SF', '0.001')}"
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = connect(str(SF_DIR))
    yield connection
    connection.close()


@pytest.mark.parametrize("key", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, key):
    assert differences(catalog.QUERIES[key](spark, str(SF_DIR)), con, catalog.ORACLES[key]) is None


def test_every_operator_has_a_query():
    assert {key.split("_")[0] for key in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}
