"""Comparing a query with its SQL twin in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb


def connect(data: str):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}{'/*.parquet' if os.path.isdir(f'{data}/{f}') else ''}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in values)


def assert_same(df, sql: str, data: str) -> None:
    con = connect(data)
    result = con.execute(sql)
    expected = rows([c[0] for c in result.description], result.fetchall())
    assert rows(df.columns, df.collect()) == expected
