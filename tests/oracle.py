"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

import datetime as dt
import glob
import math
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, dt.datetime):
        return x.isoformat()
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    return got, want
