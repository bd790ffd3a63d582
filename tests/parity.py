"""Runs queries in Spark and their oracles in DuckDB and compares rows, names and values."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def compare(df, con, sql: str) -> str:
    """Empty if both results are equal as bags of rows."""
    got, want = df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    cols = sorted(got.columns)
    bag = lambda t: sorted(map(repr, (tuple(None if x is None or pd.isna(x) else (int(x) if isinstance(x, float) and x == int(x) else x) for x in r) for r in t[cols].astype(object).itertuples(index=False, name=None))))
    a, b = bag(got), bag(want)
    if a != b:
        k = next(i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y)
        return f"{sum(x != y for x, y in zip(a, b, strict=True))} rows differ, first {a[k]} and {b[k]}"
    return ""
