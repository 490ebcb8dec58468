"""Nested section records to flat tables with parent and child links.

A payload is section records as JSON text, bare or in wrappers (``{"section": ..}``,
``{"sections": [..]}``, ``{"result": {"sections": [..]}}``, ``{"payload": ".."}``, text within text),
however many are in each other. It is parsed once into a VARIANT; a fold takes one wrapper off
at a time, as often as the payload itself can hold one. One projection then holds, for every
target table, an array of its rows: nested ``transform`` calls attach the keys and positions of
all ancestors, ``flatten`` joins what inner levels give, and one ``inline`` per target table
emits rows. No shuffle, no Python.

What has one of the four fields of a section itself is a record and isn't unwrapped, whatever
else it holds. Of several records in a payload each gives its rows; ``section_pos`` counts them.

Defined results: a null, blank, cut or otherwise unreadable payload, one with text after its
value and one with a key twice in an object give no rows. A null element keeps its position
and gives no row; an empty string is a row. A lone object stands for an array of one, and
JSON text for what it encodes. Columns of the input named in ``keys`` are carried along; all
others, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys under which a delivery may wrap records.
WRAPPERS = ("payload", "result", "record", "data", "section", "sections")
#: The fields of a section that have children.
FIELDS = ("ocr_flags", "image_ocr", "native_tables", "source_lines")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def as_array(v: Column) -> Column:
    """The elements of a variant: an array's own, one of a lone value, none of null.

    Text that encodes an array or object stands for it."""
    decoded = F.try_parse_json(_get(v, "$", "string"))
    direct = _get(v, "$", "array<variant>")
    lone = F.when(_get(v, "$", "map<string,variant>").isNotNull(), F.array(v))
    text = F.coalesce(
        _get(decoded, "$", "array<variant>"),
        F.when(_get(decoded, "$", "map<string,variant>").isNotNull(), F.array(decoded)),
        F.when(_get(v, "$", "string").isNotNull(), F.array(v)),
    )
    return F.coalesce(direct, lone, text)


def _there(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def parse_record(payload: Column) -> Column:
    """The payload as a variant, or null where it can't be read as exactly one JSON value."""
    boxed = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    return F.when(F.size(_get(boxed, "$", "array<variant>")) == 1, _get(boxed, "$[0]", "variant"))


def _is_record(v: Column) -> Column:
    out = F.lit(False)
    for k in FIELDS:
        out = out | _get(v, f"$.{k}", "variant").isNotNull()
    return out


def _is_object(v: Column) -> Column:
    return _get(v, "$", "map<string,variant>").isNotNull()


def _is_array(v: Column) -> Column:
    return _get(v, "$", "array<variant>").isNotNull()


def _meant(v: Column) -> Column:
    """What text that encodes an object or array stands for; all else as it is."""
    text = F.try_parse_json(_get(v, "$", "string"))
    # an object as text would be its JSON, so what is one isn't read again
    return F.when(_is_object(v) | _is_array(v), v).when(_is_object(text) | _is_array(text), text).otherwise(v)


def _inner(v: Column) -> Column:
    """One step inwards: an array's elements, or the value, none of them text that encodes a value."""
    meant = _meant(v)
    return F.transform(F.coalesce(_get(meant, "$", "array<variant>"), F.array(meant)), _meant)


def _unwrap(v: Column) -> Column:
    """One wrapper less: an array of what it holds; a record stays as it is."""
    held = F.flatten(F.array(*(F.coalesce(_inner(_get(v, f"$.{k}", "variant")), F.array()) for k in WRAPPERS)))
    held = F.filter(held, lambda x: _is_object(x) | _is_array(x))
    return F.when(_is_record(v) | (_is_object(v) & (F.size(held) == 0)), F.array(v)).when(_is_object(v), held).otherwise(_inner(v))


def _steps(payload: Column) -> Column:
    """As many steps as a payload can need: one for each name of a wrapper, which takes an array under it along, and one for each array right within another or at the start."""
    names = F.regexp_count(payload, F.lit(rf'"(?:{"|".join(WRAPPERS)})\\*"\s*:'))
    return names + F.regexp_count(payload, F.lit(r'\[\s*(?:\\*"\s*)?\[')) + 2


def with_records(df: DataFrame, payload: str = "payload", out: str = "_record", pos: str = "_section") -> DataFrame:
    """One row for each section record of a payload: the record as a variant and its number; payloads without one give none."""
    own = parse_record(F.col(payload))
    df = df.withColumn(out, own)
    c = F.col(out)
    alone = F.when(c.isNotNull(), F.array(c))
    steps = F.sequence(F.lit(1), _steps(F.col(payload)))
    every = F.aggregate(steps, alone, lambda a, _: F.when(F.exists(a, lambda v: ~_is_record(v)), F.flatten(F.transform(a, _unwrap))).otherwise(a))
    df = df.withColumn(out, F.when(_is_record(c), alone).otherwise(F.when(c.isNotNull(), F.filter(every, _is_record))))
    kept = [x for x in df.columns if x != out]
    return df.select(*kept, F.posexplode_outer(out).alias(pos, out)).where(F.col(out).isNotNull()).withColumn(pos, (F.col(pos) + 1).cast("int"))


def _pos(i: Column) -> Column:
    return (i + 1).cast("int")


def _text(v: Column, path: str = "$") -> Column:
    return _get(v, path, "string")


def _rows(items: Column, make) -> Column:
    """An array with make(element, position) of every element that isn't null."""
    kept = F.transform(items, lambda x, i: F.struct(x.alias("x"), _pos(i).alias("i")))
    return F.transform(F.filter(kept, lambda s: _there(s["x"])), lambda s: make(s["x"], s["i"]))


def _nested(items: Column, make) -> Column:
    """The flattened arrays make(element, position) of every element that isn't null."""
    return F.flatten(_rows(items, lambda x, i: F.coalesce(make(x, i), F.array())))


def _level(record: Column, field: str) -> Column:
    return as_array(_get(record, f"$.{field}", "variant"))


def _flag(f: Column, i: Column) -> Column:
    return F.struct(
        F.format_string("ocr_flags/%d", i).alias("path"), i.alias("pos"), _text(f, "$.id").alias("flag_id"), _get(f, "$.source_page", "int").alias("source_page"), _text(f, "$.status").alias("status"),
        _text(f, "$.reason").alias("reason"), _get(f, "$.image_sequence", "int").alias("image_sequence"), _get(f, "$.accuracy_verified", "boolean").alias("accuracy_verified"),
        _text(f, "$.detail").alias("detail"), _get(f, "$.bbox", "array<double>").alias("bbox"),
    )


def _image(f: Column, i: Column) -> Column:
    return F.struct(
        F.format_string("image_ocr/%d", i).alias("path"), i.alias("pos"), _get(f, "$.region", "int").alias("region"), _text(f, "$.markdown").alias("markdown"), _text(f, "$.status").alias("status"),
        _text(f, "$.artifact").alias("artifact"), _get(f, "$.accuracy_verified", "boolean").alias("accuracy_verified"), _get(f, "$.bbox", "array<double>").alias("bbox"),
    )


def _table(f: Column, i: Column) -> Column:
    return F.struct(F.format_string("native_tables/%d", i).alias("path"), i.alias("pos"), _text(f, "$.note").alias("note"), _get(f, "$.bbox", "array<double>").alias("bbox"))


def _line(f: Column, i: Column) -> Column:
    text = F.coalesce(_text(f, "$.text"), F.when(_get(f, "$", "map<string,variant>").isNull(), _text(f)))
    return F.struct(F.format_string("source_lines/%d", i).alias("path"), i.alias("pos"), text.alias("text"), _get(f, "$.bbox", "array<double>").alias("bbox"))


def _warnings(record: Column, field: str) -> Column:
    def one(parent: Column, i: Column) -> Column:
        return _rows(
            as_array(_get(parent, "$.quality_warnings", "variant")),
            lambda w, j: F.struct(F.format_string(f"{field}/%d/quality_warnings/%d", i, j).alias("path"), F.format_string(f"{field}/%d", i).alias("parent_path"), i.alias("parent_pos"), j.alias("pos"), _text(w).alias("warning")),
        )

    return _nested(_level(record, field), one)


def _cells(record: Column) -> Column:
    def row(t: Column):
        return lambda r, y: _rows(
            F.coalesce(_get(r, "$", "array<variant>"), F.array(r)),
            lambda c, x: F.struct(F.format_string("native_tables/%d/rows/%d/%d", t, y, x).alias("path"), F.format_string("native_tables/%d", t).alias("parent_path"), t.alias("table_pos"), y.alias("r"), x.alias("c"), _text(c).alias("value")),
        )

    return _nested(_level(record, "native_tables"), lambda v, t: _nested(as_array(_get(v, "$.rows", "variant")), row(t)))


def _merges(record: Column) -> Column:
    def corner(m: Column, k: int, name: str) -> Column:
        return F.coalesce(_get(m, f"$[{k}]", "int"), _get(m, f"$.{name}", "int")).alias(name)

    def one(table: Column, t: Column) -> Column:
        found = _get(table, "$.merges", "variant")
        # four plain numbers are one merge, not four
        lone = F.when(_get(found, "$[0]", "int").isNotNull(), F.array(found))
        return _rows(
            F.coalesce(lone, as_array(found)),
            lambda m, j: F.struct(F.format_string("native_tables/%d/merges/%d", t, j).alias("path"), F.format_string("native_tables/%d", t).alias("parent_path"), t.alias("table_pos"), j.alias("pos"), corner(m, 0, "r1"), corner(m, 1, "c1"), corner(m, 2, "r2"), corner(m, 3, "c2")),
        )

    return _nested(_level(record, "native_tables"), one)


#: Target table -> the array of its rows in a record.
TARGETS = {
    "ocr_flags": lambda v: _rows(_level(v, "ocr_flags"), _flag),
    "image_ocr": lambda v: _rows(_level(v, "image_ocr"), _image),
    "native_tables": lambda v: _rows(_level(v, "native_tables"), _table),
    "source_lines": lambda v: _rows(_level(v, "source_lines"), _line),
    "flag_warnings": lambda v: _warnings(v, "ocr_flags"),
    "image_warnings": lambda v: _warnings(v, "image_ocr"),
    "cells": _cells,
    "merges": _merges,
}


def flat_table(df: DataFrame, target: str, keys: tuple[str, ...] = ("record_id",), payload: str = "payload") -> DataFrame:
    """The rows of one target table: ``keys`` of the record, section_pos, then path, ancestors' positions and values."""
    base = with_records(df.select(*keys, F.col(payload).alias("_payload")), "_payload")
    return base.select(*keys, F.col("_section").alias("section_pos"), F.inline_outer(TARGETS[target](F.col("_record")))).where(F.col("path").isNotNull())


def child_paths(df: DataFrame, keys: tuple[str, ...] = ("record_id",), payload: str = "payload") -> DataFrame:
    """One row for each child of each record, of all target tables, in one pass over the payloads."""
    base = with_records(df.select(*keys, F.col(payload).alias("_payload")), "_payload")
    arrays = base.select(*keys, *(F.coalesce(make(F.col("_record")), F.array()).alias(f"_{k}") for k, make in TARGETS.items()))
    paths = F.concat(*(F.transform(f"_{k}", lambda s: F.struct(s["path"].alias("child_path"))) for k in TARGETS))
    # outer: an inner one makes the optimizer filter on the array's size and so build it twice
    return arrays.select(*keys, F.inline_outer(paths)).where(F.col("child_path").isNotNull())


def section_children(sections: DataFrame, key: str = "section_key") -> DataFrame:
    """The same paths from the typed nested columns of ``sections``; repeated rows count once."""

    def at(a: Column, name: str, more=None) -> Column:
        items = F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), _pos(i).alias("i"))), lambda s: s["x"].isNotNull())
        own = F.transform(items, lambda s: F.format_string(f"{name}/%d", s["i"]))
        if more is None:
            return F.coalesce(own, F.array())
        return F.coalesce(F.concat(own, F.flatten(F.transform(items, lambda s: more(s["x"], F.format_string(f"{name}/%d", s["i"]))))), F.array())

    def leaves(a: Column, path: Column, name: str) -> Column:
        items = F.filter(F.transform(a, lambda x, i: F.struct(x.isNotNull().alias("is"), _pos(i).alias("i"))), lambda s: s["is"])
        return F.coalesce(F.transform(items, lambda s: F.concat(path, F.lit(name), s["i"].cast("string"))), F.array())

    def cells(t: Column, path: Column) -> Column:
        rows = F.transform(t["rows"], lambda r, y: leaves(r, F.concat(path, F.lit("/rows/"), _pos(y).cast("string")), "/"))
        return F.concat(F.coalesce(F.flatten(rows), F.array()), leaves(t["merges"], path, "/merges/"))

    warned = lambda x, p: leaves(x["quality_warnings"], p, "/quality_warnings/")
    paths = F.concat(at(F.col("ocr_flags"), "ocr_flags", warned), at(F.col("image_ocr"), "image_ocr", warned), at(F.col("native_tables"), "native_tables", cells), at(F.col("source_lines"), "source_lines"))
    return sections.select(key, F.explode(paths).alias("child_path")).distinct()
