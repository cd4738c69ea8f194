"""Holds a Spark result against DuckDB's, as unordered rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{round(v, 5) + 0.0:.5f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(found.columns, found.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
