"""Runs queries next to their SQL in DuckDB and compares rows, whatever their order."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{source}')")
    return con


def _cell(v: object) -> object:
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo is None else v.tz_convert("UTC").tz_localize(None).isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return (t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t).isoformat()
    return str(v)


def rows(table: pa.Table) -> list[tuple]:
    """Rows with columns in order of name; Arrow keeps NULL and NaN apart, which pandas doesn't."""
    names = sorted(table.column_names)
    return sorted((tuple(map(_cell, row)) for row in zip(*(table.column(n).to_pylist() for n in names))), key=repr)


def differences(got: pa.Table, sql: pa.Table) -> str:
    if sorted(got.column_names) != sorted(sql.column_names):
        return f"columns {sorted(got.column_names)} against {sorted(sql.column_names)}"
    a, b = rows(got), rows(sql)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""
