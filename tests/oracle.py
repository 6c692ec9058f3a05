"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(directory).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6) + 0.0
    return v


def compared(spark, name: str, query, sql: str, directory: str) -> str | None:
    """What differs, or None."""
    df = query(spark, directory)
    columns = sorted(df.columns)
    ours = sorted((tuple(cell(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    rel = duck(directory).sql(sql)
    if sorted(rel.columns) != columns:
        return f"{name}: columns {columns} and {sorted(rel.columns)}"
    theirs = sorted((tuple(cell(v) for v in r) for r in rel.select(*columns).fetchall()), key=repr)
    if ours == theirs:
        return None
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"{name}: {len(ours)} and {len(theirs)} rows; only ours {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
