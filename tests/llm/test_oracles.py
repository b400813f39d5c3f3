"""Registered queries against their SQL on the smallest tables, and the names of the query contract."""

import glob
import os

import duckdb
import pytest

from keyloom.llm import oracles, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(oracles.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    key = lambda rows, names: sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(want.fetchall(), want.columns)


def test_ten_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
