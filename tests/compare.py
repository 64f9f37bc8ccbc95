"""Rows of a query on Spark and of its SQL on DuckDB, in a form that compares."""

import datetime
import glob
import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"


def database(path=DATA):
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(frame):
    names = sorted(frame.columns)
    return names, Counter(repr([plain(r[n]) for n in names]) for r in frame.collect())


def rows_by_sql(con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(repr([plain(r[i]) for i in order]) for r in got.fetchall())
