"""Compare a query with its SQL, rows as a bag, numbers by value."""

import os

import duckdb
import pandas as pd

ROOT = os.environ.get("QUIREWORK_TESTDATA", "/root/testdata")


def connect(sf: str):
    con = duckdb.connect()
    for name in os.listdir(f"{ROOT}/{sf}"):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{sf}/{name}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    return str(x)


def bag(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=str)
