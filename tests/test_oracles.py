"""Every registered query with SQL, against that SQL on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from chatlake import catalog


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(name, spark, sf, con):
    got, want = norm(catalog.QUERIES[name](spark, sf).toPandas()), norm(con.execute(catalog.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0
