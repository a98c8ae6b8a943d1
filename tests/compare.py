"""Registered queries against their SQL in DuckDB: rows as sets of rounded values, columns by name."""

import glob
import math
import os

import duckdb


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def sql(text, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    c = con.execute(text)
    return [x[0] for x in c.description], c.fetchall()


def assert_same(df, text, sf_dir):
    columns, rows = sql(text, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, rows)
