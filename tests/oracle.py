"""Compares a query with its SQL on the tables of a folder."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, bool | int) else str(v)


def rows_of_sql(sql, folder, columns):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)


def rows_of_query(df):
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def same(spark, query, sql, folder="/root/testdata/sf0.001"):
    df = query(spark, folder)
    assert rows_of_query(df) == rows_of_sql(sql, folder, df.columns)
