"""Runs a query and its statement side by side."""

import decimal
import glob
import math
import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=lambda r: tuple((x is None, str(x)) for x in r))


def both(spark, folder, query, sql):
    df = query(spark, folder)
    r = connect(folder).execute(sql)
    columns = [x[0] for x in r.description]
    return table(df.columns, df.collect()), table(columns, r.fetchall())
