"""Queries on pages, regions and markup made of whole tables, so that plain SQL knows the answer.

The given pages have no tall rules, spans or touching boxes, and the rules on these carry state
that SQL lacks. Here each page is written from rows of ``supplier`` or ``nation``, and the SQL says
from the same rows what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import grids, html_tables, hts, layout, recovery, render
from quire.operators import sections as S
from quire.operators.layout import PAGE
from quire.sources.tables import table

#: Seven columns between eight tall rules; a supplier a row, a nation a page of any height.
EDGES = (40, 110, 150, 330, 390, 440, 490, 560)


def _rows(spark: SparkSession, folder: str, name: str, by: str, order: str) -> DataFrame:
    """The columns used of the table with i from 1 and n, its place and number within ``by``."""
    columns = {"supplier": "s_suppkey, s_nationkey, s_name", "nation": "n_nationkey, n_regionkey, n_name"}[name]
    return spark.sql(f"select {columns}, row_number() over (partition by {by} order by {order}) i, count(*) over (partition by {by}) n from {{t}}", t=table(spark, folder, name))


def _object(k, kind: str, x0, y0, x1, y1, text=None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    number = lambda v: lit(v).cast("double")
    return F.struct(lit(k).cast("int").alias("obj_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(kind).alias("kind"), number(x0).alias("x0"), number(y0).alias("y0"), number(x1).alias("x1"), number(y1).alias("y1"), lit(text).cast("string").alias("text"), F.lit(1.0).alias("m_a"), F.lit(0.0).alias("m_b"))


def _objects(rows: DataFrame, doc: str, fixed: list, each: list) -> DataFrame:
    """Layout objects of one page a group: fixed ones once, others for each row."""
    one = rows.where("i = 1").select(F.col(doc).cast("bigint").alias("doc_id"), F.lit(1).alias("page_no"), F.inline(F.array(*fixed)))
    more = rows.select(F.col(doc).cast("bigint").alias("doc_id"), F.lit(1).alias("page_no"), F.inline(F.array(*each)))
    return one.unionByName(more)


def tariff_objects(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder, "supplier", "s_nationkey", "s_suppkey")
    top = 100 + 20 * F.col("n")
    foot = top - 20 * F.col("i")
    fixed = [_object(1, "page", 0, 0, 612, top + 60), *(_object(2 + j, "rule", x - 0.5, 20, x + 0.5, top + 50) for j, x in enumerate(EDGES)), _object(20, "line", 160, top + 30, 300, top + 40, "Article Description"), _object(21, "line", 395, top + 10, 430, top + 20, "General"), _object(22, "line", 445, top + 10, 480, top + 20, "Special")]
    k = 100 + 10 * F.col("i")
    each = [
        _object(k, "line", 42, foot, 100, foot + 10, F.col("s_suppkey").cast("string")), _object(k + 1, "line", 155, foot + 1.5, 250, foot + 11.5, F.col("s_name")), _object(k + 2, "line", 260, foot, 300, foot + 10, F.lit("n.e.s.")),
        _object(k + 3, "line", 392, foot - 0.5, 430, foot + 9.5, F.when(F.col("s_suppkey") % 2 == 0, "Free").otherwise(" ")),
    ]
    return _objects(rows, "s_nationkey", fixed, each)


def tariff_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Physical rows of seven labelled cells, between eight tall rules."""
    found = hts.extract(tariff_objects(spark, folder))
    rows = found.select("doc_id", F.posexplode(hts.labelled(F.col("table_rows"))).alias("_i", "r"))
    return rows.select("doc_id", (F.col("_i") + 1).alias("row_no"), *(F.col("r")[label].alias(name) for label, name in zip(hts.LABELS, ("heading", "suffix", "description", "unit", "general", "special", "column_2"), strict=True)))


def tariff_content(spark: SparkSession, folder: str) -> DataFrame:
    """A schedule's page as labelled lines under its heads."""
    return hts.extract(tariff_objects(spark, folder)).select("doc_id", "content")


def column_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that a page's tall rules (over 0.4 of its height) draw, and whether they make seven columns."""
    o = layout.objects(tariff_objects(spark, folder))
    tall = o.where("kind in ('rule', 'rect') and x1 - x0 <= 2").join(layout.page_size(o), list(PAGE)).where("y1 - y0 > height * 0.4")
    e = tall.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.bround((F.col("x0") + F.col("x1")) / 2, 1))).alias("e"))
    return e.select(*PAGE, F.size("e").alias("n_edges"), F.get("e", 0).alias("first_edge"), F.element_at("e", -1).alias("last_edge"), (F.size("e") == 8).alias("seven_columns"))


def visual_text(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that overlap by half in one visual row, each at its column, two blanks apart at least."""
    rows = _rows(spark, folder, "supplier", "s_nationkey", "s_suppkey")
    foot = 40 + 20 * (F.col("n") - F.col("i"))
    k = 10 * F.col("i")
    each = [_object(k, "line", 40, foot, 90, foot + 10, F.col("s_name")), _object(k + 1, "line", 80, foot + 4, 120, foot + 13, F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))), _object(k + 2, "line", 400, foot - 4, 450, foot + 5, F.col("s_suppkey").cast("string"))]
    return layout.inspect(_objects(rows, "s_nationkey", [_object(1, "page", 0, 0, 612, 792)], each)).select("doc_id", "layout_text")


def upright_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pages drawn turned by a quarter, a half or three, put upright by the vote of their own directions."""
    rows = _rows(spark, folder, "supplier", "s_nationkey", "s_suppkey").withColumn("q", F.col("s_nationkey") % 4)
    # the upright page is 612 wide and 1000 high; drawn so that a turn by q quarters makes it upright
    x0, y0, x1, y1 = 40.0, 5.0 * F.col("i"), 140.0, 5.0 * F.col("i") + 4
    at = lambda a, b, c, d: F.when(F.col("q") == 0, a).when(F.col("q") == 1, b).when(F.col("q") == 2, c).otherwise(d)
    lit = F.lit
    # of a turn by 90 the point (x, y) of the upright page is drawn at (612 - y, x), where the drawn page is 1000 wide
    box = (at(lit(x0), 1000 - y1, lit(612 - x1), y0), at(y0, lit(x0), 1000 - y1, lit(612 - x1)), at(lit(x1), 1000 - y0, lit(612 - x0), y1), at(y1, lit(x1), 1000 - y0, lit(612 - x0)))
    wide = F.col("q") % 2 == 1
    page = F.struct(F.lit(1).alias("obj_id"), F.lit("page").alias("kind"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(wide, 1000.0).otherwise(612.0).alias("x1"), F.when(wide, 612.0).otherwise(1000.0).alias("y1"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("m_a"), F.lit(None).cast("double").alias("m_b"))
    line = F.struct((1 + F.col("i")).cast("int").alias("obj_id"), F.lit("line").alias("kind"), box[0].alias("x0"), box[1].alias("y0"), box[2].alias("x1"), box[3].alias("y1"), F.concat(F.col("s_name"), F.lit(" of upright")).alias("text"), at(lit(1.0), lit(0.0), lit(-1.0), lit(0.0)).alias("m_a"), at(lit(0.0), lit(1.0), lit(0.0), lit(-1.0)).alias("m_b"))
    head = lambda x: (F.col("s_nationkey").cast("bigint").alias("doc_id"), F.lit(1).alias("page_no"), F.inline(F.array(x)))
    objects = rows.where("i = 1").select(*head(page)).unionByName(rows.select(*head(line)))
    return layout.upright(objects).where("kind = 'line'").select("doc_id", "obj_id", "x0", "y0", "x1", "y1", "m_a", "m_b")


def chars_in_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of a ruled grid into cells: two lines a cell, characters out of order, one table a nation."""
    rows = _rows(spark, folder, "supplier", "s_nationkey", "s_suppkey")
    top = 40 + 30 * F.col("n")
    foot = top - 30 * F.col("i")
    fixed = [_object(1, "page", 0, 0, 612, top + 20), *(_object(2 + j, "rule", x, 40, x + 0.5, top) for j, x in enumerate((40, 140, 240))), _object(9, "rule", 40, top, 240.5, top + 0.5)]
    k = 100 * F.col("i")
    digits = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    chars = [_object(k + 1, "rule", 40, foot, 240.5, foot + 0.5)] + [_object(k + 10 + j, "char", 50 + 6 * (5 - j), foot + 15, 55 + 6 * (5 - j), foot + 25, F.substring(digits, 6 - j, 1)) for j in range(6)] + [_object(k + 20 + j, "char", 150 + 6 * j, foot + y, 155 + 6 * j, foot + y + 8, c) for y, said in ((17, "ab"), (5, "cd")) for j, c in enumerate(said, 0 if y == 17 else 3)]
    return grids.cells(grids.extract(_objects(rows, "s_nationkey", fixed, chars))).select("doc_id", "r", "c", "value")


def grown_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes that touch within two points grow together, over any number of steps; two chains a page."""
    rows = _rows(spark, folder, "supplier", "s_nationkey", "s_suppkey")
    band = F.col("i") % 2
    step = F.floor((F.col("i") - 1) / 2)
    box = F.array(step * 10.0, band * 100.0 + F.when(step % 2 == 0, 0.0).otherwise(8.0), step * 10.0 + 8, band * 100.0 + F.when(step % 2 == 0, 10.0).otherwise(20.0))
    pages = rows.groupBy(F.col("s_nationkey").cast("bigint").alias("doc_id")).agg(F.collect_list(box).alias("image_regions")).select("doc_id", F.lit(1).alias("page_no"), F.lit("x").alias("raw_text"), "image_regions", F.array(F.lit(612.0), F.lit(792.0)).alias("page_size"), F.lit(0).alias("n_tables"))
    f = recovery.flags(pages)
    return f.select("doc_id", "region", "flag_id", "status", "image_sequence", *(F.get("bbox", j).alias(c) for j, c in enumerate(("x0", "y0", "x1", "y1"))))


def _html(spark: SparkSession, folder: str) -> DataFrame:
    """A table a region: a head over both columns, the region's number over all its rows, entities and line breaks."""
    rows = _rows(spark, folder, "nation", "n_regionkey", "n_nationkey")
    cell = F.concat(F.lit("<tr>"), F.when(F.col("i") == 1, F.concat(F.lit("<td rowspan="), F.col("n").cast("string"), F.lit(">R&amp;"), F.col("n_regionkey").cast("string"), F.lit("</td>"))).otherwise(""), F.lit("<td>"), F.col("n_name"), F.lit("<br>no. "), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", cell.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(F.col("n_regionkey").cast("bigint").alias("doc_id")).agg(F.concat(F.lit("<table><tr><th colspan=2>Nations</th></tr>"), body, F.lit("</table>")).alias("html"))


def html_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of tables with merged cells, each in its place."""
    return html_tables.cells(_html(spark, folder), F.col("html"), ("doc_id",))


def html_merges(spark: SparkSession, folder: str) -> DataFrame:
    """The merged ranges of the same tables."""
    p = _html(spark, folder).select("doc_id", F.explode(html_tables.parse("html")["tables"]).alias("t"))
    return p.select("doc_id", F.inline("t.merges"))


def html_stacked(spark: SparkSession, folder: str) -> DataFrame:
    """Prose before and after a table stacked with it to one grid."""
    text = F.concat(F.lit("before\n"), F.col("html"), F.lit("after"))
    g = _html(spark, folder).select("doc_id", html_tables.stacked(text).alias("g"))
    rows = g.select("doc_id", F.posexplode("g.rows").alias("r", "row"))
    return rows.select("doc_id", (F.col("r") + 1).alias("r"), F.posexplode("row").alias("c", "value")).select("doc_id", "r", (F.col("c") + 1).alias("c"), "value")


def plain_tables_readable(spark: SparkSession, folder: str) -> DataFrame:
    """Tables without merged cells as pipe tables in the text around them."""
    rows = _rows(spark, folder, "nation", "n_regionkey", "n_nationkey")
    cell = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), F.col("n_name"), F.lit("|<br>x</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", cell.alias("t")))), lambda x: x["t"]), "")
    docs = rows.groupBy(F.col("n_regionkey").cast("bigint").alias("doc_id")).agg(F.concat(F.lit("<html><body>See<table>"), body, F.lit("</table>there</body></html>")).alias("html"))
    return docs.select("doc_id", html_tables.readable_markdown("html").alias("text"))


def wrapped_made(spark: SparkSession, folder: str) -> DataFrame:
    """Cut words joined, lines that go on joined, sentences' ends, lists and blank lines kept."""
    rows = _rows(spark, folder, "supplier", "s_nationkey", "s_suppkey").select(F.col("s_suppkey").cast("bigint").alias("doc_id"), F.col("s_name").alias("s"))
    said = F.array(F.concat("s", F.lit("-")), F.lit("9 goes,"), F.lit("Then on"), F.lit("Stop."), F.lit("small"), F.lit("- item"), F.lit("after"), F.lit(""), F.concat(F.repeat(F.lit("w"), 60)), F.lit("Long"))
    return S.joined_lines(rows.select("doc_id", F.posexplode(said).alias("line_no", "line"))).select("doc_id", "line_no", "line")


def coalesced_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Native blocks beside each other as one."""
    rows = _rows(spark, folder, "supplier", "s_nationkey", "s_suppkey")
    ocr = F.col("s_suppkey") % 3 == 0
    block = F.struct("i", F.when(ocr, "ocr").otherwise("native").alias("kind"), F.col("s_name").alias("text"), F.when(ocr, F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))).alias("flag_id"))
    docs = rows.groupBy(F.col("s_nationkey").cast("bigint").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(block)), lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), b["flag_id"].alias("flag_id"))).alias("b"))
    return docs.select("doc_id", F.posexplode_outer(render.native_runs(F.col("b"))).alias("n", "x")).where("n is not null").select("doc_id", "n", "x.kind", "x.text", "x.flag_id")


#: Lines of each kind and lines that only look like it, with a nation's name.
_SAID = ("Figure 3. @", "figure @: of it", "Figure of @", "Figures 3. @", "Image 4: @", "PHOTO @. x", "Image of @", "The image 4: @", " diagram ", "Graphic", "graphics", "____----", "a=/\\|", "@ | @", "....", "...", "Illustration @. Diagram x: y")


def _said(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.transform(F.array(*map(F.lit, _SAID)), lambda x: F.replace(x, F.lit("@"), F.col("n_name")))
    return table(spark, folder, "nation").select("n_nationkey", "n_name").select(F.col("n_nationkey").cast("bigint").alias("doc_id"), F.posexplode(lines).alias("line_no", "line"))


def figure_caption_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that caption a figure."""
    return _said(spark, folder).where(X.is_figure_caption(F.col("line")))


def image_caption_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that caption an image."""
    return _said(spark, folder).where(F.col("line").rlike(X.IMAGE_CAPTION))


def image_artifact_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are the rest of an image."""
    return _said(spark, folder).where(X.is_image_artifact(F.col("line")))


_QUERIES = (figure_caption_lines, image_caption_lines, image_artifact_lines, tariff_table_rows, tariff_content, column_edges, visual_text, upright_lines, chars_in_cells, grown_boxes, html_spans, html_merges, html_stacked, plain_tables_readable, wrapped_made, coalesced_blocks)
QUERIES = {q.__name__: q for q in _QUERIES}

_S = "with s as (select *, row_number() over (partition by s_nationkey order by s_suppkey) i, count(*) over (partition by s_nationkey) n from supplier)\n"
_N = "with s as (select *, row_number() over (partition by n_regionkey order by n_nationkey) i, count(*) over (partition by n_regionkey) n from nation)\n"
_LABELLED = "'Heading/Subheading: ' || s_suppkey || ' | Article description: ' || s_name || ' n.e.s.' || case when s_suppkey % 2 = 0 then ' | General duty: Free' else '' end"
_D = "cast(s_nationkey as bigint) doc_id"
_R = "cast(n_regionkey as bigint) doc_id"
_LINES = "select cast(n_nationkey as bigint) doc_id, u.n line_no, replace(u.t, '@', n_name) line from nation, (values {0}) u(n, t)"
SQL = {
    "figure_caption_lines": _LINES.format("(0, 'Figure 3. @')") + " union all select cast(n_nationkey as bigint), 1, 'figure ' || n_name || ': of it' from nation where n_name not like '% %'",
    "image_caption_lines": _LINES.format("(4, 'Image 4: @')") + " union all select cast(n_nationkey as bigint), u.n, replace(u.t, '@', n_name) from nation, (values (5, 'PHOTO @. x'), (16, 'Illustration @. Diagram x: y')) u(n, t) where n_name not like '% %'",
    "image_artifact_lines": _LINES.format("(8, ' diagram '), (9, 'Graphic'), (11, '____----'), (12, 'a=/\\|'), (14, '....')"),
    "tariff_table_rows": _S + f"select {_D}, cast(i as int) row_no, cast(s_suppkey as varchar) heading, '' suffix, s_name || ' n.e.s.' description, '' unit, case when s_suppkey % 2 = 0 then 'Free' else '' end as general, '' special, '' column_2 from s",
    "tariff_content": _S + f"select {_D}, repeat(' ', 40) || 'Article Description' || chr(10) || repeat(' ', 99) || 'General' || repeat(' ', 5) || 'Special' || chr(10) || string_agg({_LABELLED}, chr(10) order by i) as content from s group by 1",
    "column_edges": f"select {_D}, 1 page_no, 8 n_edges, 40.0::double first_edge, 560.0::double last_edge, true seven_columns from (select distinct s_nationkey from supplier)",
    "visual_text": _S + f"""select {_D}, string_agg(t || repeat(' ', cast(greatest(2, 100 - len(t)) as bigint)) || s_suppkey, chr(10) order by i) layout_text
from (select *, repeat(' ', 10) || s_name || repeat(' ', cast(greatest(2, 20 - 10 - len(s_name)) as bigint)) || 'T' || s_suppkey as t from s) group by 1""",
    "upright_lines": _S + f"""select {_D}, cast(i + 1 as int) obj_id, 40.0::double x0, 5.0::double * i as y0, 140.0::double x1, 5.0::double * i + 4 as y1, 1.0::double m_a, 0.0::double m_b from s where s_nationkey % 4 = 0 or n * len(replace(s_name || ' of upright', ' ', '')) >= 20""",
    "chars_in_cells": _S + f"""select {_D}, cast(i as int) r, 1 c, lpad(cast(s_suppkey as varchar), 6, '0') as value from s where n >= 2
union all select {_D}, cast(i as int), 2, 'ab' || chr(10) || 'cd' from s where n >= 2""",
    "grown_boxes": _S + f"""select {_D}, cast(case when i % 2 = 1 then 1 else 2 end as int) region, 'page-1-region-' || (case when i % 2 = 1 then 1 else 2 end) flag_id, 'pending' status, 1 image_sequence, 0.0::double x0, min((i % 2) * 100.0)::double y0, (max((i - 1) // 2) * 10.0 + 8)::double x1, max((i % 2) * 100.0 + case when (i - 1) // 2 % 2 = 0 then 10 else 20 end)::double y1
from s group by s_nationkey, i % 2, case when i % 2 = 1 then 1 else 2 end""",
    "html_spans": _N + f"""select {_R}, 1 table_no, cast(i + 1 as int) r, 1 c, case when i = 1 then 'R&' || n_regionkey else '' end as value from s
union all select {_R}, 1, cast(i + 1 as int), 2, n_name || chr(10) || 'no. ' || n_nationkey from s
union all select {_R}, 1, 1, u.c, u.v from (select distinct n_regionkey from s) d, (values (1, 'Nations'), (2, '')) u(c, v)""",
    "html_merges": _N + f"""select distinct {_R}, 1 r1, 1 c1, 1 r2, 2 c2 from s union all select {_R}, 2, 1, cast(1 + max(n) as int), 1 from s where n > 1 group by 1""",
    "html_stacked": _N + f"""select {_R}, cast(i + 2 as int) r, 1 c, case when i = 1 then 'R&' || n_regionkey else '' end as value from s
union all select {_R}, cast(i + 2 as int), 2, n_name || chr(10) || 'no. ' || n_nationkey from s
union all select {_R}, u.r, u.c, u.v from (select distinct n_regionkey from s) d, (values (1, 1, 'before'), (2, 1, 'Nations'), (2, 2, '')) u(r, c, v)
union all select distinct {_R}, cast(n + 3 as int), 1, 'after' from s""",
    "plain_tables_readable": _N + f"""select {_R}, 'See' || chr(10) || '| Column 1 | Column 2 |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || '\\|<br>x |', chr(10) order by i) || chr(10) || 'there' as text from s group by 1""",
    "wrapped_made": """select cast(s_suppkey as bigint) doc_id, u.n line_no, replace(u.t, '@', s_name) line from supplier,
(values (0, '@9 goes, Then on'), (3, 'Stop.'), (4, 'small'), (5, '- item'), (6, 'after'), (7, ''), (8, repeat('w', 60) || ' Long')) u(n, t)""",
    "coalesced_blocks": _S + f""", k as (select *, s_suppkey % 3 = 0 o from s), g as (select *, sum(case when o or coalesce(lag_o, true) then 1 else 0 end) over (partition by s_nationkey order by i) b from (select *, lag(o) over (partition by s_nationkey order by i) lag_o from k))
select {_D}, cast(b - 1 as int) n, case when bool_or(o) then 'ocr' else 'native' end as kind, string_agg(s_name, chr(10) order by i) as text, max(case when o then 'T' || s_suppkey end) flag_id from g group by s_nationkey, b""",
}
