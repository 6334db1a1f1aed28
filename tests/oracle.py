"""A query's rows against its SQL in DuckDB."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    return sorted((tuple(plain(x) for x in r) for r in data), key=repr)


def same(df, sql):
    found = views().sql(sql)
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    want = found.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows(columns, df.select(*columns).collect()) == rows(columns, want)
