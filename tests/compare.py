"""Rows of a query and of its SQL, for comparison."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict") or isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def database(folder: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(x) for x in r) for r in df.select(*cols).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(x[i]) for i in order) for x in r.fetchall())
