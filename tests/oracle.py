"""Runs a registered query and its SQL in DuckDB over the same tables, and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that is the same for both engines."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}" if value != int(value) or abs(value) > 1e15 else int(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value) if isinstance(value, datetime.date) else value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """None if both give the same rows, else what differs."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, want.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}: {sorted(set(ours) ^ set(theirs))[:4]}"
    if ours != theirs:
        k = next(i for i in range(len(ours)) if ours[i] != theirs[i])
        return f"{sum(a != b for a, b in zip(ours, theirs))} rows differ, first {ours[k]} against {theirs[k]}"
    return None
