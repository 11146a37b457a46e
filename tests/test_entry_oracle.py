"""Driver contract and the DuckDB oracle for every registered SQL key (sf0.001)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vigil.sources.tables import TABLES

SMALL = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "psi" in df.columns


def test_keys_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, key):
    sp = entry.queries()[key](spark, SMALL).toPandas()
    dk = duck.execute(entry.oracle_sql()[key]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    cols = sorted(sp.columns)

    def rows(df):
        return sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)

    assert rows(sp) == rows(dk)
