"""Comparison of a Spark result with a DuckDB one, whatever their row order."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int | float):
        return None if value != value else round(float(value), 6)
    return str(value)


def same(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda row: tuple((v is not None, str(type(v)), v) for v in row)
    left = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    right = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=key)
    assert left == right
