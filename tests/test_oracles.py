"""Every registered query against its SQL twin on the small tables."""

import datetime
import glob
import math
import os
import time

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        v = float(v)
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(v) if v.__class__.__name__ == "Decimal" else str(v)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    t0 = time.time()
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    took = time.time() - t0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    print(f"{name}: {len(rows)} rows, {took:.1f} s")
    if name not in ORACLES:
        assert rows
        return
    rel = duck.execute(ORACLES[name])
    want = _table([d[0] for d in rel.description], rel.fetchall())
    got = _table(df.columns, rows)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert want[1], "the query finds nothing, so it shows nothing"
    for g, w in zip(got[1], want[1]):
        assert g == w
