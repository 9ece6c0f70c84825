"""Compares a query's rows with those of its SQL in DuckDB."""

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(data=DATA):
    con = duckdb.connect()
    for p in Path(data).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def cell(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def assert_same(df, sql, data=DATA):
    found = connect(data).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())
