"""Every query with SQL gives the same rows as that SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from quaver.plans import catalogue
from tests.oracle import connection, rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got, want = catalogue.queries()[name](spark, FOLDER).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    """Where no SQL says the same: rows, columns of known types, and the same rows once more."""
    got = catalogue.queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0 and not got.columns.duplicated().any()
    assert rows(got) == rows(catalogue.queries()[name](spark, FOLDER).toPandas())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
