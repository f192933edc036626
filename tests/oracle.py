"""Compares a query with its SQL the way the driver does: rows, columns, and values in any order."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, query, sql):
    """None when both agree, else what differs."""
    df = query(spark, sf)
    cur = con.execute(sql)
    a = table(df.columns, [tuple(r) for r in df.collect()])
    b = table([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} != {len(b[1])}"
    for x, y in zip(a[1], b[1]):
        if x != y:
            return f"{x}\n!= {y}"
    return None
