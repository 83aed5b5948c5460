"""Every library query against its oracle SQL on a small scale, and queries without one by their shape."""

import math

import duckdb
import pytest

from tickloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "orders", "events", "documents", "labels"]
#: Slow queries that fit models; only the operators behind them are tested.
SLOW = {"regime_tree_leaves", "ml_rf_predict", "fi_mdi"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(tuple(norm(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name not in ORACLES:
        assert got.columns
        return
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in sorted(names)) for r in found.fetchall())
    assert rows == want
