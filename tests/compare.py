"""Comparison of a Spark result with DuckDB's on the same tables."""

import decimal
import glob
import numbers
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (numbers.Number, decimal.Decimal)):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    return str(v)


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
