"""Comparing a Spark result with the DuckDB result of its check SQL."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def database(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return repr(value + 0.0 if value else 0.0)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)[:10]
    return str(value) if not isinstance(value, (int, str)) else value


def difference(df, con, sql: str) -> str:
    """'' when names and rows agree, else a short description."""
    spark_names = sorted(df.columns)
    left = Counter(tuple(_plain(r[n]) for n in spark_names) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    if sorted(names) != spark_names:
        return f"columns differ: spark {spark_names} sql {sorted(names)}"
    at = [names.index(n) for n in spark_names]
    right = Counter(tuple(_plain(r[i]) for i in at) for r in rows)
    if left == right:
        return ""
    only_left, only_right = list((left - right).elements()), list((right - left).elements())
    return (f"rows spark {sum(left.values())} sql {sum(right.values())}; {len(only_left)} differ\n  {spark_names}\n"
            f"  spark {sorted(only_left, key=str)[:2]}\n  sql   {sorted(only_right, key=str)[:2]}")
