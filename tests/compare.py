"""Comparison of a DataFrame with a DuckDB result, as multisets of rows, columns by name."""

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(c.lower() for c in columns), Counter(tuple(norm(r[i]) for i in order) for r in data)


def duck(sql, d):
    c = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    rel = c.sql(sql)
    return rows(rel.columns, rel.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def difference(df, sql, d):
    """None if equal, else what differs."""
    names, got = spark_rows(df)
    wanted_names, wanted = duck(sql, d)
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if got != wanted:
        return f"{sum(got.values())} and {sum(wanted.values())} rows; only ours {list((got - wanted).items())[:3]}; only SQL {list((wanted - got).items())[:3]}"
    return None
