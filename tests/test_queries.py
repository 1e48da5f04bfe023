"""Every query with SQL gives the same rows as DuckDB on the smallest data, where that is at hand."""

import os

import pytest

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


def names():
    from loomstead.plans import catalogue

    return sorted(catalogue.SQL)


@pytest.fixture(scope="module")
def con():
    import compare

    return compare.connect(ROOT)


@pytest.mark.parametrize("name", names())
def test_same_as_sql(spark, con, name):
    import compare
    from loomstead.plans import catalogue

    mine, theirs = catalogue.QUERIES[name](spark, ROOT).toPandas(), con.execute(catalogue.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert compare.normal(mine) == compare.normal(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
