"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_against_sql import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.CORPUS_QUERIES])
def test_query_matches_its_sql(spark, con, name):
    assert name in entry.oracle_sql()
    assert compare(spark, con, FOLDER, name) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["tick", "total", "diff"] and df.count() > 0
