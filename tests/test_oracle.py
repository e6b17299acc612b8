"""Every query against its SQL on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from helixframe.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "null" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    sql = duck.execute(q.sql)
    names = [c[0] for c in sql.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, sql.fetchall())
