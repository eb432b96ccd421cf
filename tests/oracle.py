"""Runs a query in Spark and its SQL in DuckDB on the same files, and compares rows without regard to order."""

from __future__ import annotations

import glob
import math
import os
from datetime import datetime

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}" if float(v) != int(v) else str(int(v))
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(value, v)) + "]"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def check(spark, sf_dir, query, sql, con=None):
    con = con or connect(sf_dir)
    got = query(spark, sf_dir)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert mine == theirs
