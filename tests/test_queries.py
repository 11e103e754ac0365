"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from kgjobs import queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def canon(rows):
    def value(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v)

    return sorted([tuple(value(v) for v in r) for r in rows])


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    if name not in queries.SQL:
        assert df.count() >= 0
        return
    want = db.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert canon(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == canon(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
