"""Rows of a query against its SQL in DuckDB, regardless of order."""

import glob
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def views():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def same(spark, query, sql):
    df = query(spark, SF_DIR)
    got = rows_of(df.columns, df.collect())
    cursor = views().execute(sql)
    return got, rows_of([d[0] for d in cursor.description], cursor.fetchall())
