"""A result next to that of its SQL, as sorted rows of text."""

import datetime
import glob
import math
import os

import duckdb


def text(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def connection(root):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{root}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return c


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(text(r[c]) for c in names) for r in df.collect())


def rows_of_sql(c, sql):
    rel = c.sql(sql)
    order = [rel.columns.index(x) for x in sorted(rel.columns)]
    return sorted(rel.columns), sorted(tuple(text(r[k]) for k in order) for r in rel.fetchall())
