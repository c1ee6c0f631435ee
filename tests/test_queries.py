"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["pages", "documents", "embeddings"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(data):
    return sorted((tuple(r) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    """Those of the optional part have tests of their own."""
    assert set(entry._QUERIES) == set(entry.oracle.oracle_sql())


@pytest.mark.parametrize("name", list(entry._QUERIES))
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got.select(*names).collect()) == rows(want.select(*[f'"{n}"' for n in names]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
