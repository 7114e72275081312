from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from debtscope.session import local_session

    return local_session("tests", partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def values(df, column):
    """Evaluate one expression on a one-column frame, in row order of ``id``."""
    return [row[0] for row in df.select(column.alias("v"), "id").orderBy("id").select("v").collect()]


@pytest.fixture
def evaluate(spark):
    """``evaluate(column, [(a, b), ...], "a string, b int")`` -> list of results."""

    def run(column, rows, schema):
        numbered = [(i, *row) for i, row in enumerate(rows)]
        return values(spark.createDataFrame(numbered, f"id int, {schema}"), column)

    return run
