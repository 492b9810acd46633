"""Runs a query and its SQL on the same tables and compares rows without regard to order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def sql_rows(d, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{d}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    return cols, sorted((tuple(map(value, r)) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(value, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect()), key=repr)


def differences(spark, d, query, sql):
    a, b = spark_rows(query(spark, d)), sql_rows(d, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        x, y = set(a[1]), set(b[1])
        return f"{len(a[1])} and {len(b[1])} rows; only here {sorted(x - y, key=repr)[:2]}; only in SQL {sorted(y - x, key=repr)[:2]}"
    return ""
