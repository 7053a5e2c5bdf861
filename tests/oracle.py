"""Comparison of a Spark result with DuckDB's over the same files."""

import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def _cell(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)):
        return repr(round(float(v), 5) + 0.0)
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(_cell(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)
