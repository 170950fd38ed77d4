"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from skyroll.oracle import oracle_sql
from skyroll.registry import queries

from support import SF_SMALL

# The training-data queries of the entry have their own tests.
QUERIES, ORACLE = queries(), oracle_sql()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["lineitem", "orders"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "normalize"):
        return str(v.normalize())
    return v


def _sorted(rows):
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "flights" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    names = df.columns
    got = _sorted([tuple(_norm(r[c]) for c in sorted(names)) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    dnames = [d[0] for d in cur.description]
    assert sorted(dnames) == sorted(names)
    idx = [dnames.index(c) for c in sorted(names)]
    want = _sorted([tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()])
    assert got == want


def test_no_query_reads_outside_the_tables():
    # registered queries take their input from sf_dir only
    import inspect
    import skyroll.registry as reg
    src = inspect.getsource(reg)
    assert "/root/testdata" not in src and os.sep + "tmp" not in src
