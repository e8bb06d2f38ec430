"""Comparing a query's result with that of its SQL, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().replace(tzinfo=None)
    return v.item() if hasattr(v, "item") else v


def difference(got, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the rows agree, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = Counter(tuple(plain(r[i]) for i in at) for r in want_rows)
    have = Counter(tuple(plain(x) for x in r) for r in got.select(*order).collect())
    missing, extra = want - have, have - want
    if missing or extra:
        return f"{sum(want.values())} rows wanted; missing {sum(missing.values())} {list(missing)[:3]}; extra {sum(extra.values())} {list(extra)[:3]}"
    return ""
