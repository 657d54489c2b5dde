"""Spark vs DuckDB result comparison used by the tests and by hand.

Mirrors the driver's check: same row count, same column names, and an
order-insensitive hash of the values with columns sorted by name.
"""

from __future__ import annotations

import hashlib
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def rows_hash(columns, rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(str(_norm(r[i])) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {
        "rows_spark": len(s_rows),
        "rows_oracle": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "hash_match": rows_hash(s_cols, s_rows) == rows_hash(d_cols, d_rows),
    }
    if not out["hash_match"]:
        so = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        do = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        a = sorted(tuple(_norm(r[i]) for i in so) for r in s_rows)
        b = sorted(tuple(_norm(r[i]) for i in do) for r in d_rows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["cols"] = (s_cols, d_cols)
        out["first_diffs"] = diff
    out["ok"] = out["rows_spark"] == out["rows_oracle"] and out["columns_match"] and out["hash_match"]
    return out
