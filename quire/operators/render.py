"""Page records to Markdown and JSON documents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

#: Keys that a JSON record has even if null; all others go where they are null.
KEPT_NULL = ("chapter",)


def fenced(text: Column) -> Column:
    f = X.fence(text)
    return F.concat(f, F.lit("text\n"), text, F.lit("\n"), f)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: what a lambda names that isn't its variable is evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def native_runs(blocks: Column) -> Column:
    """Adjacent native blocks as one, joined by line ends: the array is cut where a run begins, so each block is read once."""
    kind = "array<struct<kind:string,text:string,flag_id:string>>"

    def runs(blocks: Column) -> Column:
        native = lambda i: F.coalesce(F.get(blocks, i)["kind"] == "native", F.lit(False))
        begins = F.filter(F.sequence(F.lit(0), F.size(blocks) - 1), lambda i: (i == 0) | ~(native(i) & native(i - 1)))
        cut = lambda begins: F.transform(begins, lambda start, k: _once(F.slice(blocks, start + 1, F.coalesce(F.get(begins, k + 1), F.size(blocks)) - start), joined))
        return F.when(F.size(blocks) > 0, _once(begins, cut)).otherwise(F.when(blocks.isNotNull(), F.array().cast(kind)))

    def joined(part: Column) -> Column:
        first = F.get(part, F.lit(0))
        text = F.when(F.size(part) > 1, F.array_join(F.transform(part, lambda b: b["text"]), "\n")).otherwise(first["text"])
        return F.struct(first["kind"].alias("kind"), text.alias("text"), first["flag_id"].alias("flag_id"))

    return _once(blocks.cast(kind), runs).cast(kind)


def section_markdown(sid: Column, title: Column, warnings: Column, text: Column, ocr: Column, blocks: Column | None = None) -> Column:
    """A page: heading, review notes, then its blocks in order, or its recognized text before the native one."""
    head = F.concat(F.lit("## "), sid, F.lit(" "), title, F.lit("\n\n"))
    notes = F.array_join(F.transform(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: F.concat(F.lit("> Extraction review: "), w, F.lit("\n\n"))), "")
    native = fenced(F.coalesce(text, F.lit("")))
    plain = F.when(F.coalesce(ocr, F.lit("")) != "", F.concat(ocr, F.lit("\n\n### Native PDF text for comparison\n\n"), native)).otherwise(native)
    if blocks is None:
        return F.concat(head, notes, plain)
    inner = F.array_join(F.transform(native_runs(blocks), lambda b: F.when(b["kind"] == "ocr", F.concat(F.lit("> OCR text — accuracy unverified; compare with the source.\n\n"), b["text"])).otherwise(fenced(b["text"]))), "\n\n")
    return F.concat(head, notes, F.when(F.size(F.coalesce(blocks, F.array().cast("array<struct<kind:string,text:string,flag_id:string>>"))) > 0, inner).otherwise(plain))


def documents_markdown(sections: DataFrame, title: str = "title", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, markdown: the pages (seq, section_markdown) of each document under its title."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "section_markdown"))), lambda x: x["section_markdown"]), "\n\n")
    whole = sections.groupBy(*keys).agg(F.coalesce(F.first(title), F.lit("Unknown")).alias("_t"), body.alias("_b"))
    return whole.select(*keys, F.concat(X.strip(F.concat(F.lit("# "), F.col("_t"), F.lit("\n\n"), F.col("_b"))), F.lit("\n")).alias("markdown"))


def pruned(record: dict) -> dict:
    """A record without null keys, but for those that stay null."""
    return {k: v for k, v in record.items() if v is not None or k in KEPT_NULL}


def document_json(record: dict) -> str:
    """A document as indented JSON, characters as they are."""
    out = pruned(record)
    if "sections" in out:
        out["sections"] = [pruned(s.asDict(True) if hasattr(s, "asDict") else s) for s in out["sections"]]
    return json.dumps(out, ensure_ascii=False, indent=2)
