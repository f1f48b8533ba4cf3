"""Compares a query with its SQL, run by DuckDB on the same tables."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "replace") and hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


def compare(spark, folder, query, sql):
    got = query(spark, folder)
    told = connect(folder).execute(sql)
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(got.columns)
    want, have = rows(names, told.fetchall()), rows(got.columns, got.collect())
    assert len(want) == len(have)
    assert want == have
    return have
