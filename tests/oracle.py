"""Compares a query with its SQL on DuckDB, rows in any order."""

import math
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(folder):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, pd.Timestamp):
        return str(v)
    return v


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    found = [tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)]
    return columns, sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


def check(spark, con, query, sql: str, folder: str) -> None:
    assert rows(query(spark, folder).toPandas()) == rows(con.sql(sql).df())
