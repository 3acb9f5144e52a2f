"""Compares a query with its SQL, as rows of sorted columns."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(d):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        c.execute(f"create view {name} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal | float | int):
        f = float(v)
        return "nan" if math.isnan(f) else f + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def compare(spark, c, d, f, sql):
    df = f(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
