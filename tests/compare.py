"""Compares Spark results with DuckDB statements over the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _key(row):
    return tuple((x is None, str(type(x)), round(x, 6) if isinstance(x, float) and math.isfinite(x) else x) if not isinstance(x, float) else (False, "f", round(x, 6)) for x in row)


def difference(df, sql: str, sf_dir: str) -> list:
    """Rows on one side only (floats to about six digits), or the column names if they differ."""
    got_cols = sorted(df.columns)
    rel = duck(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != got_cols:
        return [("columns", got_cols, sorted(names))]
    want = sorted((tuple(r[names.index(c)] for c in got_cols) for r in rel.fetchall()), key=lambda r: tuple(map(str, r)))
    got = sorted((tuple(r[c] for c in got_cols) for r in df.collect()), key=lambda r: tuple(map(str, r)))
    if len(got) != len(want):
        return [("rows", len(got), len(want))]

    def near(a, b):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-6) if isinstance(a, float) and isinstance(b, (float, int)) else a == b

    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(near(x, y) for x, y in zip(g, w, strict=True))]
    return bad[:5]
