"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from keelson.plans import catalogue

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: "~" if pd.isna(v) else repr(float(v)) if not isinstance(v, (str, bool, pd.Timestamp)) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_duckdb(spark, duck, name):
    got, wanted = QUERIES[name](spark, DIR).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert _rows(got) == _rows(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
