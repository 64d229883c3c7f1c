"""Runs a query and its DuckDB SQL over the same tables and compares rows."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v if isinstance(v, int) else str(v)


def compare(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
