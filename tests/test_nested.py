"""Nested records against a plain reading of the same JSON."""

import json

from quire.operators import nested as N


def plain(payload):
    try:
        o = json.loads(payload)
    except (TypeError, ValueError):
        return set()

    def decoded(x):
        if isinstance(x, str):
            try:
                y = json.loads(x)
            except ValueError:
                return x
            return y if isinstance(y, (dict, list)) else x
        return x

    def items(x):
        x = decoded(x)
        return [] if x is None else x if isinstance(x, list) else [x]

    def records(x):
        x = decoded(x)
        if isinstance(x, list):
            return [r for e in x for r in records(e)]
        if not isinstance(x, dict):
            return []
        if any(f in x for f in N.FIELDS):
            return [x]
        return [r for k in N.WRAPPERS if k in x for r in records(x[k])]

    out = set()
    for n, o in enumerate(records(o), 1):
        for f in N.FIELDS:
            for i, e in enumerate(items(o.get(f)), 1):
                if e is None:
                    continue
                out.add((n, f"{f}/{i}"))
                if f.startswith(("ocr", "image")):
                    out |= {(n, f"{f}/{i}/quality_warnings/{j}") for j, w in enumerate(items(e.get("quality_warnings")), 1) if w is not None}
                if f == "native_tables":
                    out |= {(n, f"{f}/{i}/rows/{y}/{x}") for y, r in enumerate(items(e.get("rows")), 1) for x, c in enumerate(items(r), 1) if c is not None}
                    out |= {(n, f"{f}/{i}/merges/{j}") for j, m in enumerate(items(e.get("merges")), 1) if m is not None}
    return out


RECORD = {"ocr_flags": [None, {"id": "a", "quality_warnings": ["x", None, ""]}], "native_tables": {"rows": [["a", None, ""], [], [1]], "merges": [[1, 1, 1, 2]]}, "source_lines": [{"text": "t"}, None], "image_ocr": None}


def test_wrappers_and_edges(spark):
    r = json.dumps(RECORD)
    payloads = [
        r, f" {r}\n", json.dumps({"section": RECORD}), json.dumps({"sections": [RECORD]}), json.dumps({"result": {"sections": [RECORD]}}), json.dumps({"payload": r}), json.dumps([RECORD]),
        json.dumps(RECORD | {"ocr_flags": json.dumps(RECORD["ocr_flags"])}), json.dumps(RECORD | {"ocr_flags": RECORD["ocr_flags"][1]}), r[:-20], r + " x", "", " ", "{", "null", "3", "[]", None, "{}", json.dumps({"source_lines": []}),
    ]
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "record_id bigint, payload string, child_path string")
    got = {i: [] for i in range(len(payloads))}
    for i, p in N.child_paths(df).collect():
        got[i].append(p)
    for i, p in enumerate(payloads):
        assert sorted(got[i]) == sorted(x for _, x in plain(p)), p


def test_any_number_of_wrappers_and_records(spark):
    """A seventh wrapper and more, text within text within text, arrays in arrays, several sections, own fields beside a record's."""
    deep, text, arrays = RECORD, RECORD, RECORD
    for k in range(12):
        deep = {N.WRAPPERS[k % 6]: deep}
        arrays = [arrays, None] if k % 2 else {"sections": [[], arrays]}
    for _ in range(4):
        text = {"payload": json.dumps(text)}
    payloads = [
        json.dumps(x)
        for x in (
            deep, text, arrays, json.dumps(json.dumps(RECORD)), {"sections": [RECORD, None, {"section": RECORD}, "x", 3, json.dumps(RECORD)]}, [[RECORD], [RECORD]], RECORD | {"data": {"a": 1}, "result": [RECORD], "payload": "x"},
            {"data": RECORD, "result": {"sections": [RECORD]}, "title": "a"}, {"payload": {"title": "of no field", "data": 3}}, {"note": RECORD}, {"section": {"source_lines": [{"text": '"payload": [[{'}], "data": []}},
        )
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "record_id bigint, payload string")
    got = {i: set() for i in range(len(payloads))}
    for t in N.TARGETS:
        for r in N.flat_table(df, t).collect():
            assert (r.section_pos, r.path) not in got[r.record_id]
            got[r.record_id].add((r.section_pos, r.path))
    for i, p in enumerate(payloads):
        assert got[i] == plain(p), p
    assert len({n for n, _ in got[4]}) == 3 and got[0] and got[1]


def test_duplicate_keys_are_unreadable(spark):
    df = spark.createDataFrame([(1, '{"source_lines": [], "source_lines": [{"text": "a"}]}')], "record_id bigint, payload string")
    assert N.child_paths(df).count() == 0


def test_flat_tables_hold_links_and_values(spark):
    df = spark.createDataFrame([(7, json.dumps(RECORD))], "record_id bigint, payload string")
    cells = {(r.r, r.c, r.value) for r in N.flat_table(df, "cells").collect()}
    assert cells == {(1, 1, "a"), (1, 3, ""), (3, 1, "1")}
    flag = N.flat_table(df, "ocr_flags").collect()
    assert [(r.record_id, r.path, r.pos, r.flag_id) for r in flag] == [(7, "ocr_flags/2", 2, "a")]
    warned = N.flat_table(df, "flag_warnings").collect()
    assert {(r.parent_path, r.pos, r.warning) for r in warned} == {("ocr_flags/2", 1, "x"), ("ocr_flags/2", 3, "")}
    merge = N.flat_table(df, "merges").collect()[0]
    assert (merge.r1, merge.c1, merge.r2, merge.c2) == (1, 1, 1, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id bigint, payload string")
    assert N.child_paths(df).count() == 0
    assert all(N.flat_table(df, t).count() == 0 for t in N.TARGETS)


def test_whole_table_against_plain(spark, data):
    df = spark.read.parquet(f"{data}/raw_records.parquet")
    got = {(r[0], r[1]) for r in N.child_paths(df).collect()}
    assert got == {(i, p) for i, x in df.select("record_id", "payload").collect() for _, p in plain(x)}
