"""Every core query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from vecloom.plans import diff, log, store, streams, vectors

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = (vectors, store, log, streams, diff)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLE = {n: q for m in MODULES for n, q in m.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        name = f.split(".")[0]
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(values):
    out = []
    for v in values:
        if isinstance(v, float):
            v = None if math.isnan(v) else round(v, 5) + 0.0
        out.append(str(v))
    return tuple(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(plain(r) for r in found.select(*columns).collect())
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    assert got == sorted(plain(r) for r in result)
