"""Every query with SQL gives the rows that DuckDB gives."""

import os

import pytest

from tests.oracle import compare, connect
from weftline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert con.execute(ORACLES[name]).fetchone(), "an empty answer proves nothing"
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
