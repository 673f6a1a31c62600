"""Run a registered query and its SQL side by side and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(row count, problem or None)"""
    mine = _rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return sum(mine.values()), f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine != theirs:
        return sum(mine.values()), (
            f"{sum(mine.values())} rows against {sum(theirs.values())}; "
            f"only here {list((mine - theirs).items())[:3]}; "
            f"only in SQL {list((theirs - mine).items())[:3]}"
        )
    return sum(mine.values()), None
