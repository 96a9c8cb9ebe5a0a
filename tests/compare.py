"""Side-by-side comparison of a registered query and its SQL form."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda c: columns[c])
    return Counter(tuple(_value(row[c]) for c in order) for row in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = rows_of(want_columns, cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_columns):
        return False, f"columns {sorted(df.columns)} against {sorted(want_columns)}"
    if got != want:
        extra, lost = list((got - want).items())[:2], list((want - got).items())[:2]
        return False, f"{sum(got.values())} rows against {sum(want.values())}; only here {str(extra)[:600]}; only in SQL {str(lost)[:600]}"
    return True, f"{sum(got.values())} rows"
