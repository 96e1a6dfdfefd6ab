"""Registered queries against their SQL twins on the smallest sample."""

import os

import pytest

from gleaner.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are missing")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() > 0
        return
    same, message = compare(con, df, ORACLES[name])
    assert same, message
