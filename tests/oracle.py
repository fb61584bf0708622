"""Comparison of a Spark query with its SQL twin: names, row count and values, order-free."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data), sorted(names)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, otherwise a short description."""
    df = query(spark, sf_dir)
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, want_names = rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"{name}: columns {names} vs {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"{name}: {len(got)} vs {len(want)} rows {names}; only Spark {extra}; only SQL {missing}"
    return None
