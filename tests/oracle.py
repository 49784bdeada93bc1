"""Run a registered query in Spark and its SQL in DuckDB, and compare as unordered rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from catalog.views import BASE


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str, seen: list | None = None) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if seen is not None:
        seen.append(len(got))
    res = con.execute(sql)
    want_cols, want = normal([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        have, need = set(got), set(want)
        missing = [r for r in want if r not in have][:3]
        extra = [r for r in got if r not in need][:3]
        return f"rows {len(got)} vs {len(want)}; only in SQL {missing}; only in Spark {extra}"
    return None
