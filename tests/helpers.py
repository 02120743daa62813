"""Comparison of a Spark result with DuckDB's, without regard to order."""

import os

import duckdb


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        path = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def assert_same(df, con, sql: str) -> int:
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    place = [rel.columns.index(c) for c in names]
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    assert got == want
    return len(got)
