"""Runs registered queries next to their checks and compares the rows as multisets."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from workload.registry import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql: str, folder: str) -> str | None:
    """None when both agree, else what differs."""
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra, lack = got - want, want - got
        return (f"{sum(got.values())} rows against {sum(want.values())}\n  only Spark ({sum(extra.values())}): "
                f"{list(extra)[:2]}\n  only SQL ({sum(lack.values())}):   {list(lack)[:2]}")
    return "both empty" if not got else None
