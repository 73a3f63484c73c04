"""Compares a query's rows with DuckDB's on the same files."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if v is not None and not isinstance(v, (str, int, bool)):
        try:
            return round(float(v), 6) + 0.0
        except (TypeError, ValueError):
            return str(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def difference(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    got, names = rows(df.columns, df.collect())
    found = con.execute(sql)
    want, wanted = rows([c[0] for c in found.description], found.fetchall())
    if names != wanted:
        return f"columns {names} and {wanted}"
    if got == want:
        return ""
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {[r for r in got if r not in set(want)][:2]} {[r for r in want if r not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}"
