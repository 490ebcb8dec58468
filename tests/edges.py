"""Folders of odd tables: empty, of nulls, with columns that operators use as names."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

NAMES = "_n _line line line_no n kind field region h1 h2 rep weight date total ends _ends _spans key word i x f b p _s _t _g _i _l _o _r _e _p _in _free filled _record _first _gone dom nodes seq title_ stem block status_ _order _bucket at use rank slot share limits first last point".split()


def names_of(df):
    return [c for c in NAMES if c not in df.columns]


def write(spark, data, folder, change):
    for p in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(p)
        change(spark.read.parquet(p)).coalesce(1).write.parquet(f"{folder}/{name}")
    return str(folder)


def empty(df):
    return df.limit(0)


def nulls(df):
    none = df.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
    return df.limit(30).unionByName(none).unionByName(none).unionByName(df.limit(3))


def clashing(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in names_of(df)))
