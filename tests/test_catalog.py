"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

from catalog import load
from tests.oracle import compare, duck

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
CHECKS = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, con, name):
    query, sql = CHECKS[name]
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert compare(spark, con, SF, query, sql) is None
