"""Running a query's SQL in DuckDB and comparing rows."""

import math
import os
from decimal import Decimal

import duckdb


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con.sql(sql)


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float | Decimal):
        return f"{float(v):.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    want = oracle(sql, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
