"""Every registered query against its SQL."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from compare import connect, difference

QUERIES, SQL = entry.QUERIES, entry.all_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_names():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    assert difference(spark, duck, sf_dir, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
