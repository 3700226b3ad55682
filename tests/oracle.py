"""Comparison of a query with its DuckDB oracle."""

import datetime
import decimal
import math
import os


def normal(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 9))
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    if isinstance(v, dict):
        return "[" + ",".join(map(normal, v.values())) + "]"
    return repr(v)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def compare(df, con, sql):
    cols = sorted(df.columns)
    spark_rows = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    duck_rows = sorted(tuple(normal(r[i]) for i in at) for r in got.fetchall())
    assert spark_rows == duck_rows
