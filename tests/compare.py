"""Compare Spark rows with DuckDB rows, whatever their order."""

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:23]
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(sf):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        path = f"{sf}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def check(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    a = sorted((tuple(plain(x) for x in r) for r in df.select(*(df[f"`{c}`"] for c in cols)).collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
    assert a == b
