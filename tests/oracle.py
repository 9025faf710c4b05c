"""Rows of a query and of its oracle in a comparable form."""

import datetime
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def duck_rows(sql, folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        con.sql(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    r = con.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
