"""Every query with SQL gives the same rows as DuckDB, on the smallest test tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    ref = con.execute(entry.oracle_sql()[name])
    want = rows([x[0] for x in ref.description], ref.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
