"""Compares a query's rows with those of its SQL in DuckDB."""

import collections
import glob
import math
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def counted(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    a, b = counted(df.collect(), df.columns), counted(want.fetchall(), want.columns)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
