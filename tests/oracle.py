"""Comparison of a query's rows with those of its SQL on DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def sql_rows(sql, sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = db.sql(sql)
    return found.columns, found.fetchall()


def assert_same(df, sql, sf_dir):
    columns, rows = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert have == want
