"""Compare a registered query with its SQL, as the driver does: by columns, types of values, and rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([canonical(r[i]) for i in order]) for r in data)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"{len(got)} rows and {len(want)}; only here {a[:2]}, only there {b[:2]}"
    return "" if got else "no rows"
