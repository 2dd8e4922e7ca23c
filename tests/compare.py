"""Compare a Spark result with the same query's SQL result."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is pd.NA:
        return None
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and value != value:
        return None  # pandas writes a null number so, and it equals nothing
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value.item() if hasattr(value, "item") else value


def normalized(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    a, b = normalized(spark_rows), normalized(sql_rows)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    return f"{len(a)} / {len(b)} rows; spark only {only_a[:3]}; sql only {only_b[:3]}"
