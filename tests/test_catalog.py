"""Every registered query of the library proper against DuckDB at the smallest scale."""

import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from geocadence.plans import catalog, more

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | more.QUERIES, catalog.ORACLES | more.ORACLES


def plain(v):
    """Integers as they are; other numbers to six decimals (queries round themselves where engines may differ)."""
    if pd.isna(v):
        return ""
    if isinstance(v, (str, bool, np.bool_, int, np.integer)):
        return str(v)
    v = float(v)
    return str(int(v)) if isinstance(v, (float, Decimal)) and v.is_integer() else f"{v:.6f}"


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    assert len(ours)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
