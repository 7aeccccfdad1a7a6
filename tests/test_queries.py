"""Every registered query beside its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as e
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(e.queries()))
def test_query(spark, con, name):
    df = e.queries()[name](spark, FOLDER)
    if name in e.oracle_sql():
        verdict = compare(df, con, e.oracle_sql()[name], [])
        assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
    else:
        assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
