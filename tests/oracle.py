"""Comparison of a query's rows with its SQL in DuckDB."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return format(v, ".9g")
    if isinstance(v, decimal.Decimal):
        return format(float(v), ".9g")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None else str(v)


def agree(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(str(plain(r[i])) for i in order) for r in cursor.fetchall())
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(str(plain(r[c])) for c in sorted(df.columns)) for r in df.collect())
    assert got == want
