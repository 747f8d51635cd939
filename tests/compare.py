"""Comparing a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if hasattr(x, "tolist") and not isinstance(x, str | bytes):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return "NULL"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    return str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))
