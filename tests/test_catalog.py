"""Every registered query against its SQL, over whole tables at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, problem

FOLDER = os.environ.get("CATALOG_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    rows = entry.queries()[name](spark, FOLDER).toPandas()
    assert len(rows)
    if name in ORACLES:
        assert problem(rows, duck.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["i", "j", "v"]
