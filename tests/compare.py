"""Spark query against DuckDB SQL on the same tables, as multisets of rows."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 6) if isinstance(x, float) else x


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(repr(tuple(map(plain, r))) for r in frame[cols].astype(object).itertuples(index=False, name=None))


def same(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), connected(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)
