"""Holds a query's rows against its SQL's, by DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def same(df, sql: str, c: duckdb.DuckDBPyConnection) -> None:
    rel = c.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs
