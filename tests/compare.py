"""Order-insensitive comparison of a Spark result with a DuckDB one."""

import os

import duckdb
import pandas as pd


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
    frame = frame.apply(lambda c: c.astype(float) if c.dtype.kind in "iu" or str(c.dtype) == "Int64" else c)
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), key=str)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con
