"""Compare a query with its DuckDB SQL on the same Parquet tables, row for row."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if os.path.exists(path) or path.endswith("*.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    return v


def rows(cols: list[str], data) -> list[tuple]:
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_plain(r[i]) for i in at) for r in data), key=repr)


def compare(df, sql: str, sf_dir: str) -> tuple[int, list]:
    """The number of rows, and up to five differences (side, row); raises if the columns differ."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != sorted(df.columns):
        raise AssertionError(f"columns differ: {sorted(df.columns)} against {sorted(cols)}")
    want = rows(cols, rel.fetchall())
    if got == want:
        return len(got), []
    from collections import Counter

    a, b = Counter(got), Counter(want)
    return len(got), [("spark", r) for r in (a - b)][:5] + [("sql", r) for r in (b - a)][:5]
