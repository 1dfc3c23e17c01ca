"""Every query with an SQL equivalent gives the same rows on the smallest tables."""

import os

import pytest

import catalog

SF_DIR = "/root/testdata/sf0.001"
catalog.load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not found")


@pytest.fixture(scope="module")
def duck():
    from check import connect

    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    from check import compare

    assert compare(catalog.QUERIES[name](spark, SF_DIR), duck, catalog.ORACLES[name]).startswith("ok")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["word", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
