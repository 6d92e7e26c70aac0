"""Compares a query with its SQL on DuckDB, row by row and without regard to order."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(source):
            con.execute(f"create view {t} as select * from read_parquet('{source}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    return v


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both sides agree, else what differs first."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    got = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(_plain(r[c]) for c in order) for r in got), key=repr)
    at = [names.index(c) for c in order]
    b = sorted((tuple(_plain(r[i]) for i in at) for r in want), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; e.g. {(set(a) ^ set(b)).pop() if a and b else (a or b)[:1]}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{order}: {x} against {y}"
    return ""
