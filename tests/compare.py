"""Comparison of a query with its SQL, row by row."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return repr(value)


def differences(spark, folder: str, query, sql: str, most: int = 3) -> list[str]:
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    cursor = connect(folder).execute(sql)
    theirs_names = [c[0] for c in cursor.description]
    if sorted(theirs_names) != names:
        return [f"columns {names} and {sorted(theirs_names)}"]
    theirs = sorted(tuple(plain(dict(zip(theirs_names, r))[n]) for n in names) for r in cursor.fetchall())
    if ours == theirs:
        return []
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return [f"{len(ours)} and {len(theirs)} rows", *(f"only Spark: {r}" for r in sorted(a)[:most]), *(f"only SQL: {r}" for r in sorted(b)[:most])]
