"""Every query of the engine against DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

from quadrille.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cur = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())
