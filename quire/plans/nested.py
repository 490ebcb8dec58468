"""Queries of problem 1: flat tables of nested section records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators import nested
from quire.sources.tables import table

#: What a flat table shows beside its keys; arrays stay out, as SQL engines write them differently.
COLUMNS = {
    "ocr_flags": ("path", "pos", "flag_id", "source_page", "status", "reason", "image_sequence", "detail"),
    "image_ocr": ("path", "pos", "region", "markdown", "status", "artifact"),
    "native_tables": ("path", "pos", "note"),
    "source_lines": ("path", "pos", "text"),
    "flag_warnings": ("path", "parent_path", "parent_pos", "pos", "warning"),
    "image_warnings": ("path", "parent_path", "parent_pos", "pos", "warning"),
    "cells": ("path", "parent_path", "table_pos", "r", "c", "value"),
    "merges": ("path", "parent_path", "table_pos", "pos", "r1", "c1", "r2", "c2"),
}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.child_paths(table(spark, folder, "raw_records"))


def p1_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The same children of the typed columns of ``sections``."""
    return nested.section_children(table(spark, folder, "sections"))


def _flat(target: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.flat_table(table(spark, folder, "raw_records"), target).select("record_id", *COLUMNS[target])

    query.__name__ = f"p1_{target}"
    return query


QUERIES = {"p1_found": p1_found, "p1_sections": p1_sections} | {f"p1_{t}": _flat(t) for t in nested.TARGETS}

# The record of each payload in DuckDB: JSON text of an array of one value, unwrapped step by step.
_RECORD = """
with recursive v as (
  select record_id, case when json_valid('[' || payload || ']') and json_array_length('[' || payload || ']') = 1 then json_extract('[' || payload || ']', '$[0]') end j from raw_records),
u(record_id, j, d) as (
  select record_id, j, 0 from v where j is not null
  union all
  select record_id, case
    when json_type(j) = 'ARRAY' then j->'$[0]'
    when json_type(j) = 'VARCHAR' and json_valid(j->>'$') then cast(j->>'$' as json)
    when json_type(j->'$.payload') = 'VARCHAR' and json_valid(j->>'$.payload') then cast(j->>'$.payload' as json)
    when json_type(j->'$.payload') in ('OBJECT', 'ARRAY') then j->'$.payload'
    when json_type(j->'$.result') in ('OBJECT', 'ARRAY') then j->'$.result'
    when json_type(j->'$.section') in ('OBJECT', 'ARRAY') then j->'$.section'
    when json_type(j->'$.sections') in ('OBJECT', 'ARRAY') then j->'$.sections'
    else j end, d + 1 from u where d < 5),
r as (select record_id, j from u where d = 5 and json_type(j) = 'OBJECT'),
f as (select record_id, unnest(['ocr_flags', 'image_ocr', 'native_tables', 'source_lines']) field, unnest([j->'$.ocr_flags', j->'$.image_ocr', j->'$.native_tables', j->'$.source_lines']) j from r),
g as (select record_id, field, case when json_type(j) = 'VARCHAR' and json_valid(j->>'$') then cast(j->>'$' as json) else j end j from f),
a as (select record_id, field, case when json_type(j) = 'ARRAY' then from_json(j, '["json"]') when json_type(j) in ('OBJECT', 'VARCHAR') then [j] else [] end items from g where j is not null),
e as (select record_id, field, unnest(items) x, unnest(range(1, len(items) + 1)) i from a),
c as (select * from e where x is not null and json_type(x) <> 'NULL'),
w as (select record_id, field, i, from_json(x->'$.quality_warnings', '["json"]') items from c where field in ('ocr_flags', 'image_ocr') and json_type(x->'$.quality_warnings') = 'ARRAY'),
w1 as (select record_id, field, i, unnest(items) y, unnest(range(1, len(items) + 1)) j from w),
t as (select record_id, i, from_json(x->'$.rows', '["json"]') items from c where field = 'native_tables' and json_type(x->'$.rows') = 'ARRAY'),
t1 as (select record_id, i, unnest(items) y, unnest(range(1, len(items) + 1)) r from t),
t2 as (select record_id, i, r, from_json(y, '["json"]') items from t1 where json_type(y) = 'ARRAY'),
t3 as (select record_id, i, r, unnest(items) z, unnest(range(1, len(items) + 1)) k from t2),
m as (select record_id, i, from_json(x->'$.merges', '["json"]') items from c where field = 'native_tables' and json_type(x->'$.merges') = 'ARRAY'),
m1 as (select record_id, i, unnest(items) y, unnest(range(1, len(items) + 1)) j from m)
"""

_I = "cast({0} as int)"
SQL = {
    "p1_found": _RECORD
    + """
select record_id, field || '/' || i as child_path from c
union all select record_id, field || '/' || i || '/quality_warnings/' || j from w1 where json_type(y) <> 'NULL'
union all select record_id, 'native_tables/' || i || '/rows/' || r || '/' || k from t3 where json_type(z) <> 'NULL'
union all select record_id, 'native_tables/' || i || '/merges/' || j from m1 where json_type(y) <> 'NULL'""",
    "p1_ocr_flags": _RECORD + "select record_id, field || '/' || i as path, cast(i as int) pos, x->>'$.id' flag_id, cast(x->>'$.source_page' as int) source_page, x->>'$.status' status, x->>'$.reason' reason, cast(x->>'$.image_sequence' as int) image_sequence, x->>'$.detail' detail from c where field = 'ocr_flags'",
    "p1_image_ocr": _RECORD + "select record_id, field || '/' || i as path, cast(i as int) pos, cast(x->>'$.region' as int) region, x->>'$.markdown' markdown, x->>'$.status' status, x->>'$.artifact' artifact from c where field = 'image_ocr'",
    "p1_native_tables": _RECORD + "select record_id, field || '/' || i as path, cast(i as int) pos, x->>'$.note' note from c where field = 'native_tables'",
    "p1_source_lines": _RECORD + "select record_id, field || '/' || i as path, cast(i as int) pos, x->>'$.text' as text from c where field = 'source_lines'",
    "p1_flag_warnings": _RECORD + "select record_id, field || '/' || i || '/quality_warnings/' || j as path, field || '/' || i as parent_path, cast(i as int) parent_pos, cast(j as int) pos, y->>'$' warning from w1 where field = 'ocr_flags' and json_type(y) <> 'NULL'",
    "p1_image_warnings": _RECORD + "select record_id, field || '/' || i || '/quality_warnings/' || j as path, field || '/' || i as parent_path, cast(i as int) parent_pos, cast(j as int) pos, y->>'$' warning from w1 where field = 'image_ocr' and json_type(y) <> 'NULL'",
    "p1_cells": _RECORD + "select record_id, 'native_tables/' || i || '/rows/' || r || '/' || k as path, 'native_tables/' || i as parent_path, cast(i as int) table_pos, cast(r as int) r, cast(k as int) c, z->>'$' as value from t3 where json_type(z) <> 'NULL'",
    "p1_merges": _RECORD
    + "select record_id, 'native_tables/' || i || '/merges/' || j as path, 'native_tables/' || i as parent_path, cast(i as int) table_pos, cast(j as int) pos, cast(coalesce(y->>'$[0]', y->>'$.r1') as int) r1, cast(coalesce(y->>'$[1]', y->>'$.c1') as int) c1, cast(coalesce(y->>'$[2]', y->>'$.r2') as int) r2, cast(coalesce(y->>'$[3]', y->>'$.c2') as int) c2 from m1 where json_type(y) <> 'NULL'",
    "p1_sections": """
with s as (select distinct section_key, ocr_flags, image_ocr, native_tables, source_lines from sections),
f as (select section_key, unnest(ocr_flags) x, unnest(range(1, len(ocr_flags) + 1)) i from s), m as (select section_key, unnest(image_ocr) x, unnest(range(1, len(image_ocr) + 1)) i from s),
n as (select section_key, unnest(native_tables) x, unnest(range(1, len(native_tables) + 1)) i from s), l as (select section_key, unnest(source_lines) x, unnest(range(1, len(source_lines) + 1)) i from s),
r as (select section_key, i, unnest(x.rows) y, unnest(range(1, len(x.rows) + 1)) r from n where x is not null),
p as (
select section_key, 'ocr_flags/' || i as child_path from f where x is not null
union all select section_key, 'image_ocr/' || i from m where x is not null union all select section_key, 'native_tables/' || i from n where x is not null union all select section_key, 'source_lines/' || i from l where x is not null
union all select section_key, 'ocr_flags/' || i || '/quality_warnings/' || j from (select section_key, i, unnest(x.quality_warnings) y, unnest(range(1, len(x.quality_warnings) + 1)) j from f) where y is not null
union all select section_key, 'image_ocr/' || i || '/quality_warnings/' || j from (select section_key, i, unnest(x.quality_warnings) y, unnest(range(1, len(x.quality_warnings) + 1)) j from m) where y is not null
union all select section_key, 'native_tables/' || i || '/merges/' || j from (select section_key, i, unnest(x.merges) y, unnest(range(1, len(x.merges) + 1)) j from n) where y is not null
union all select section_key, 'native_tables/' || i || '/rows/' || r || '/' || k from (select section_key, i, r, unnest(y) z, unnest(range(1, len(y) + 1)) k from r) where z is not null)
select distinct section_key, child_path from p""",
}
