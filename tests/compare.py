"""Runs a registered query and its SQL counterpart and compares the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from notewright.plans.views import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(repr(plain(r[i])) for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Number of rows and what differs (nothing when equal)."""
    left_columns, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    right_columns, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    out = []
    if left_columns != right_columns:
        out.append(f"columns {left_columns} vs {right_columns}")
    only_left, only_right = left - right, right - left
    if only_left or only_right:
        out.append(f"{sum(only_left.values())} / {sum(only_right.values())} rows differ of {sum(left.values())} / {sum(right.values())}")
        out += [f"  spark {str(r)[:700]}" for r in sorted(only_left)[:2]] + [f"  sql   {str(r)[:700]}" for r in sorted(only_right)[:2]]
    return sum(left.values()), out
