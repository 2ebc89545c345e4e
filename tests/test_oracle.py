"""Every registered query equals its DuckDB oracle SQL on the small scale factor."""
import datetime as dt
import math

import duckdb
import pytest

from learnlog.plans.oracle import ORACLE
from learnlog.plans.queries import QUERIES
from learnlog.sources.tables import TABLES

from conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    s = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[key])
    ocols = [d[0] for d in res.description]
    o = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(s) == len(o)
    assert _rows(df.columns, s) == _rows(ocols, o)
