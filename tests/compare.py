"""A query's rows next to DuckDB's."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    places = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted("|".join(plain(r[i]) for i in places) for r in found.fetchall())
