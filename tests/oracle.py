"""Holds a query's rows against its SQL, run by DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)[:19]
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in values), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def compare(df, sql, con):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = rows(names, got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    assert len(want) == len(have), (len(want), len(have), want[:3], have[:3])
    for w, h in zip(want, have):
        assert w == h, (w, h)
    return len(have)
