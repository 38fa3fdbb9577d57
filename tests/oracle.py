"""Compares a query with its SQL on the test tables."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with a view for each table of a data folder."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def cell(x: object) -> str:
    if x is None or x is pd.NA:
        return "null"
    if isinstance(x, float | np.floating):
        return "null" if x != x else str(int(x)) if x == int(x) else repr(round(float(x), 6))
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    """Rows in a form that doesn't depend on column order, row order or how nulls are kept."""
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False, name=None))
