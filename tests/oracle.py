"""Compares a query with its SQL on DuckDB: same columns and the same rows, in any order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(normal, v)) + "]"
    return str(v)


def differences(df, sql: str, sf: str) -> list:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(k) for k in sorted(names)]
    want = sorted(tuple(normal(r[i]) for i in at) for r in got.fetchall())
    have = sorted(tuple(normal(r[k]) for k in sorted(df.columns)) for r in df.collect())
    return [] if want == have else [len(have), len(want), sorted(set(have) - set(want))[:3], sorted(set(want) - set(have))[:3]]
