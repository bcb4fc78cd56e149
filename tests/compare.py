"""Run a registered query in Spark and its check SQL in DuckDB and compare the row bags."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def compare(df, con, sql):
    """A list of differences, empty if equal."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    expected = bag(names, rel.fetchall())
    got = bag(df.columns, df.collect())
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    diff = [(g, e) for g, e in zip(got, expected) if g != e]
    if diff:
        problems.append(f"{len(diff)} rows differ, e.g. {diff[0]}")
    kinds = [
        (type(a).__name__, type(b).__name__)
        for g, e in zip(got[:50], expected[:50])
        for a, b in zip(g, e)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    if kinds:
        problems.append(f"types differ {kinds[:3]}")
    return problems
