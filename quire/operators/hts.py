"""Tariff schedules: physical table rows of seven columns from lines and long rules."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.operators.layout import PAGE, anchored, objects, visual_line

# The labels of the columns, and what marks such a table.
LABELS = ("Heading/Subheading", "Statistical suffix", "Article description", "Unit of quantity", "General duty", "Special duty", "Column 2 duty")
DOCUMENT_TITLE = "Harmonized Tariff Schedule of the United States"
ROW_NOTICE = "Table rows are physical lines, not complete records; use source coordinates and layout for hierarchy and continuations."
ROW_SEMANTICS = "Physical lines; blank cells and continuations are not inferred."
MARK, HEADS = "Article Description", {"General", "Special"}
TITLE = r"(?i)Harmonized\s+Tariff\s+Schedule"
_OUT = T.StructType([T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("lines", T.ArrayType(T.StringType()))])


def page_rows(lines: list[dict], edges: list[float]) -> dict:
    """Cells of the table's physical rows, and every row as a line.

    A row takes what is within two points of its first line's foot; it is one of the table if it lies below
    the heads and all of its lines begin between the outer edges."""
    said = lambda o: (o["text"] or "").strip()
    filled = sorted((o for o in lines if said(o)), key=lambda o: (-o["y0"], o["x0"], o.get("obj_id", 0)))
    is_table = len(edges) == len(LABELS) + 1 and any(MARK in o["text"] for o in filled)
    top = min((o["y0"] for o in filled if said(o) in HEADS), default=0) - 3
    starts = [e - 1 for e in edges]
    table, out = [], []
    for run in anchored(filled, 2):
        row = sorted(run, key=lambda o: (o["x0"], o.get("obj_id", 0)))
        if is_table and run[0]["y0"] < top and edges[0] - 2 <= row[0]["x0"] and row[-1]["x0"] < edges[-1]:
            parts: dict[int, list[str]] = {}
            for o in row:
                parts.setdefault(bisect_right(starts, o["x0"]) - 1, []).append(said(o))
            cells = [" ".join(parts.get(c, ())) for c in range(len(LABELS))]
            table.append(cells)
            out.append(" | ".join(f"{k}: {v}" for k, v in zip(LABELS, cells, strict=True) if v))
        else:
            out.append(visual_line(row, 1).rstrip())
    return {"rows": table, "lines": out}


@F.arrow_udf(_OUT)
def _rows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for lines, edges in batches:
        yield pa.array([page_rows(a or [], b or []) for a, b in zip(lines.to_pylist(), edges.to_pylist(), strict=True)], pa.struct([("rows", pa.list_(pa.list_(pa.string()))), ("lines", pa.list_(pa.string()))]))


def labelled(rows: Column) -> Column:
    """Rows of seven cells as structs under their columns' labels."""
    return F.transform(rows, lambda r: F.struct(*(F.get(r, i).alias(k) for i, k in enumerate(LABELS))))


def is_schedule(page_texts: DataFrame, pages: int = 5) -> DataFrame:
    """doc_id, is_hts: whether one of the first pages (doc_id, page_no, raw_text) names the schedule."""
    return page_texts.where(F.col("page_no") <= pages).groupBy("doc_id").agg(F.max(F.coalesce(F.col("raw_text").rlike(TITLE), F.lit(False))).alias("is_hts"))


def extract(df: DataFrame) -> DataFrame:
    """doc_id, page_no, table_rows (arrays of seven cells), content of each page."""
    once = objects(df)
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pages = once.groupBy(*PAGE).agg(F.max(F.when(F.col("kind") == "page", height)).alias("_h"), F.collect_list(F.when((F.col("kind") == "line") & (X.strip(F.coalesce("text", F.lit(""))) != ""), F.struct("obj_id", "x0", "x1", "y0", "y1", "text"))).alias("_l"), F.collect_list(F.when(F.col("kind").isin("rule", "rect") & (width <= 2), F.struct(height.alias("h"), F.bround((F.col("x0") + F.col("x1")) / 2, 1).alias("x")))).alias("_r"))
    edges = F.array_sort(F.array_distinct(F.transform(F.filter("_r", lambda r: r["h"] > F.col("_h") * 0.4), lambda r: r["x"])))
    out = pages.withColumn("_e", edges).withColumn("_x", _rows("_l", "_e"))
    return out.select(*PAGE, F.col("_x.rows").alias("table_rows"), F.array_join("_x.lines", "\n").alias("content"))
