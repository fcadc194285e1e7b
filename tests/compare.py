"""Rows of a query beside those that DuckDB gives for its SQL."""

from __future__ import annotations

import datetime as dt
import glob
import os
from decimal import Decimal

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    """A value in a form that both sides share; kinds of numbers stay apart."""
    if isinstance(v, Decimal):
        return f"d{v:f}"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "f0.0" if v == 0 else f"f{v!r}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "~" if v is None else str(v)


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), table(df.columns, df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), table(columns, cur.fetchall())
