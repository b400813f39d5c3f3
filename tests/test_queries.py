"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from keyloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else float(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_gives_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
