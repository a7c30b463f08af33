"""Every query with SQL against DuckDB on the smallest tables; the others return rows of a stable schema."""

import math

import duckdb
import pytest

from rayframe import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert rows
    if name not in Q.SQL:
        return
    result = duck.execute(Q.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(x[names.index(c)] for c in columns) for x in result.fetchall()), key=str)
    assert len(rows) == len(want)
    assert all(close(p, q) for a, b in zip(rows, want, strict=True) for p, q in zip(a, b, strict=True))
