"""Runs a query and its SQL side by side."""

import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def same_rows(spark, query, sql, sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    df = query(spark, sf)
    columns = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected
