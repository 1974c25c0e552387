"""Rows of a query against rows of its SQL."""

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return repr(v) if isinstance(v, (list, dict, tuple)) else v


def rows_of(dicts, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in dicts), key=repr)


def sql_rows(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        con.execute(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows_of([dict(zip(names, r, strict=True)) for r in cur.fetchall()], sorted(names))


def agree(df, sql, folder):
    columns = sorted(df.columns)
    names, wanted = sql_rows(sql, folder)
    assert columns == names
    assert rows_of([r.asDict(recursive=True) for r in df.collect()], columns) == wanted
