"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from checks import load_checks
from checks.base import Tables
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
CHECKS = load_checks()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, con, name):
    fn, sql = CHECKS[name]
    df = fn(Tables(spark, FOLDER))
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None
