"""Queries on page layout: text, orientation, regions, grids, tariff rows, chapters; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import grids, hts, layout
from quire.operators.layout import PAGE
from quire.plans.prose import strip
from quire.sources.tables import table


def objects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "layout_objects")


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Raw text, counts and sizes of each page, from its objects."""
    p = layout.inspect(objects(spark, folder))
    return p.select(*PAGE, "raw_text", F.size("source_lines").alias("n_lines"), "image_count", F.get("page_size", 0).alias("width"), F.get("page_size", 1).alias("height"))


def page_issues(spark: SparkSession, folder: str) -> DataFrame:
    p = layout.inspect(objects(spark, folder))
    return p.select(*PAGE, F.explode_outer("warnings").alias("issue")).where("issue is not null")


def page_layout_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's lines in visual rows, at their columns."""
    return layout.inspect(objects(spark, folder)).select(*PAGE, "layout_text")


def page_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Image and vector regions of each page."""
    return layout.inspect(objects(spark, folder)).select(*PAGE, F.posexplode("image_regions").alias("n", "b")).select(*PAGE, "n", F.col("b")[0].alias("x0"), F.col("b")[1].alias("y0"), F.col("b")[2].alias("x1"), F.col("b")[3].alias("y1"))


def orientation_vote(spark: SparkSession, folder: str) -> DataFrame:
    return layout.orientation(layout.objects(objects(spark, folder)))


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text, in reading order."""
    return layout.objects(objects(spark, folder)).where((F.col("kind") == "line") & (X.strip(F.coalesce("text", F.lit(""))) != "")).select(*PAGE, "obj_id", "text")


def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    return objects(spark, folder).select(*PAGE).distinct().groupBy("doc_id").agg(F.count("*").alias("n_pages"))


#: Pages with a ruled grid each, made of the table nation: a page a region, a row a nation, its key and name in two columns.
_GRID = """
with r as (select n_regionkey, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) i from {nation}),
g as (select n_regionkey, max(i) n from r group by n_regionkey),
x as (select 40D x union all select 140D union all select 240D),
o as (
  select n_regionkey, 1 k, 0 i, 'page' kind, 0D x0, 0D y0, 612D x1, 792D y1, cast(null as {text}) text from g
  union all select n_regionkey, 2, cast(x as int), 'rule', x, 700D - 30 * n, x + 0.5D, 700D, null from g, x
  union all select n_regionkey, 3, i, 'rule', 40D, 700D - 30 * i, 240D, 700.5D - 30 * i, null from r
  union all select n_regionkey, 4, 0, 'rule', 40D, 700D, 240D, 700.5D, null from g
  union all select n_regionkey, 5, i, 'line', 45D, 680D - 30 * (i - 1), 100D, 690D - 30 * (i - 1), cast(n_nationkey as {text}) from r
  union all select n_regionkey, 6, i, 'line', 145D, 680D - 30 * (i - 1), 200D, 690D - 30 * (i - 1), n_name from r)
select n_regionkey doc_id, 1 page_no, cast(row_number() over (partition by n_regionkey order by k, i) as int) obj_id, cast(null as int) parent_id, cast(null as {text}) source, kind, x0, y0, x1, y1, text, 1D m_a, 0D m_b from o
"""


def ruled_objects(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(_GRID.replace("{text}", "string"), nation=table(spark, folder, "nation"))


def chain_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the left edges of each page's lines."""
    lines = layout.objects(objects(spark, folder)).where("kind = 'line'")
    return layout.chain_clusters(lines, "x0", PAGE).select(*PAGE, F.col("cluster").cast("int").alias("cluster"), F.round("mean", 6).alias("mean"), "n")


def rule_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Vertical rules of each page by their span."""
    o = layout.objects(ruled_objects(spark, folder)).where("kind in ('rule', 'rect') and x1 - x0 <= 1 and y1 - y0 >= 20")
    return o.groupBy(*PAGE, F.bround("y0").cast("int").alias("low"), F.bround("y1").cast("int").alias("high")).agg(F.count("*").alias("n"), F.min("x0").alias("left"), F.max("x1").alias("right"))


def column_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Which column (between the edges of a page's vertical rules) the middle of each line lies in; -1 before the first."""
    o = layout.objects(ruled_objects(spark, folder))
    mids = o.where("kind in ('rule', 'rect') and x1 - x0 <= 1 and y1 - y0 >= 20").groupBy(*PAGE).agg(F.array_sort(F.collect_set((F.col("x0") + F.col("x1")) / 2)).alias("edges"))
    lines = o.where("kind = 'line' and text is not null").join(mids, list(PAGE))
    return lines.select(*PAGE, "obj_id", layout.bucket((F.col("x0") + F.col("x1")) / 2, F.col("edges")).alias("bucket"))


def ruled_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the ruled tables of the pages made of nations."""
    return grids.cells(grids.extract(ruled_objects(spark, folder)))


def page_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the ruled tables of all pages of layout_objects."""
    return grids.cells(grids.extract(objects(spark, folder)))


def vector_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Figures over 20 points a side whose children draw lines and hold neither text nor image."""
    o = layout.objects(objects(spark, folder))
    figures = o.where("kind = 'figure' and x1 - x0 > 20 and y1 - y0 > 20")
    child = o.select(*PAGE, F.col("parent_id").alias("obj_id"), "kind").where("obj_id is not null")
    on = [*PAGE, "obj_id"]
    return figures.join(child.where("kind in ('rule', 'rect')"), on, "left_semi").join(child.where("kind in ('char', 'image')"), on, "left_anti").select(*on, "x0", "y0", "x1", "y1")


def chapter_carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    return layout.carried_chapters(objects(spark, folder))


def tariff_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Tariff pages: each page's lines in rows at their columns, and cells where rules make seven columns."""
    return hts.extract(objects(spark, folder)).select(*PAGE, "content", F.size("table_rows").alias("n_table_rows"))


def hts_probe(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "sections").select("doc_id", F.col("source_page").alias("page_no"), "raw_text")
    return hts.is_schedule(pages)


def crop_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Pixel boxes of each section's image regions at 300 dots an inch."""
    s = table(spark, folder, "sections").dropDuplicates(["section_key"])
    rows = s.select("section_key", F.posexplode("image_regions").alias("n", "b"), F.coalesce(F.get("page_size", 0), F.lit(612.0)).alias("width"), F.coalesce(F.get("page_size", 1), F.lit(792.0)).alias("height"), F.col("orientation_correction").alias("turn"))
    boxes = rows.select("section_key", "n", *(F.get("b", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))), "width", "height", "turn")
    return layout.crop_boxes(boxes).select("section_key", "n", "left", "upper", "right", "lower")


def capacity_formula(spark: SparkSession, folder: str) -> DataFrame:
    """Workers that fit, over made-up machines: customers' balances as GiB."""
    c = table(spark, folder, "customer")
    ram, peak = F.abs(F.col("c_acctbal")) / 100, (F.col("c_custkey") % 8).cast("double")
    budget = layout.worker_budget(peak)
    return c.select("c_custkey", budget.alias("budget"), layout.capacity(ram, budget).alias("cpu_workers"), layout.capacity(ram, budget, ram / 2, budget).alias("gpu_workers"))


def lines_conserved(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and characters of each document's page records, and how many lines its objects have that these haven't, and the other way round."""
    src = layout.objects(objects(spark, folder)).where((F.col("kind") == "line") & (X.strip(F.coalesce("text", F.lit(""))) != "")).select(*PAGE, F.regexp_replace("text", "\n+$", "").alias("line"))
    out = layout.inspect(objects(spark, folder)).select(*PAGE, F.explode("source_lines").alias("l")).select(*PAGE, F.col("l.text").alias("line"))
    lost = src.exceptAll(out).groupBy("doc_id").agg(F.count("*").alias("lost"))
    made = out.exceptAll(src).groupBy("doc_id").agg(F.count("*").alias("made"))
    pages = out.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    return pages.join(lost, "doc_id", "left").join(made, "doc_id", "left").select("doc_id", "n_lines", "n_chars", F.coalesce("lost", F.lit(0).cast("bigint")).alias("lost"), F.coalesce("made", F.lit(0).cast("bigint")).alias("made"))


def page_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Running count of a document's pages and lines, as a progress report shows it."""
    p = page_text(spark, folder).select(*PAGE, "n_lines")
    w = Window.partitionBy("doc_id").orderBy("page_no")
    return p.select(*PAGE, F.row_number().over(w).alias("done"), F.count("*").over(Window.partitionBy("doc_id")).alias("total"), F.sum("n_lines").over(w).alias("lines_so_far"))


_QUERIES = (page_text, page_issues, page_layout_text, page_regions, orientation_vote, text_lines, page_counts, chain_cluster, rule_groups, column_buckets, ruled_tables, page_tables, vector_figures, chapter_carry_forward, tariff_rows, hts_probe, crop_boxes, capacity_formula, lines_conserved, page_progress)
QUERIES = {q.__name__: q for q in _QUERIES}

_G = "with o as (" + _GRID.replace("{text}", "varchar").replace("{nation}", "nation").replace("0D", "0::double").replace(".5D", ".5::double").replace("792D", "792::double").replace("612D", "612::double").replace("45D", "45::double").replace("145D", "145::double").replace("1D m_a", "1::double m_a") + "),\n"
_O = "with o as (select distinct on (doc_id, page_no, obj_id) * from layout_objects order by doc_id, page_no, obj_id),\n"
_TEXT = strip("coalesce(text, '')")
_P = _O + f"""n as (select *, kind = 'line' and {_TEXT} <> '' is_line from o),
p as (select doc_id, page_no, coalesce(string_agg(case when is_line then regexp_replace(text, '\\n+$', '') end, chr(10) order by obj_id), '') raw_text, cast(count(*) filter (is_line) as int) n_lines, cast(count(*) filter (kind = 'image') as int) image_count,
  max(case when kind = 'page' then x1 - x0 end) width, max(case when kind = 'page' then y1 - y0 end) height, coalesce(bool_or(kind in ('rule', 'rect') and greatest(x1 - x0, y1 - y0) > 50), false) rules from n group by 1, 2)
"""
_RAW = strip("raw_text")
_S = "with s as (select distinct on (section_key) * from sections order by section_key)"
SQL = {
    "page_text": _P + "select doc_id, page_no, raw_text, n_lines, image_count, width, height from p",
    "page_issues": _P
    + f""", i as (select doc_id, page_no, unnest([case when {_RAW} = '' then 'No extractable text: page may be blank, scanned, or contain vector outlines; review/OCR required.' when length({_RAW}) < 40 then 'Sparse text: review page for missing content.' end,
  case when image_count > 0 then 'Embedded images are not transcribed; review figures and any text inside images.' end, case when contains(raw_text, chr(65533)) or regexp_matches(raw_text, '\\(cid:\\d+\\)') then 'Unresolved font characters detected; review/OCR required.' end,
  case when rules then 'Rules or vector graphics detected; table relationships and diagrams require review.' end]) issue from p) select * from i where issue is not null""",
    "orientation_vote": _O
    + """a as (select *, (degrees(atan2(m_b, m_a)) + 360) % 360 ang, length(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', '', 'g')) n from o where kind in ('line', 'char') and m_a is not null),
q as (select *, (round_even(ang / 90, 0) * 90) % 360 q from a where n > 0), v as (select doc_id, page_no, q, sum(n) n, min(obj_id) first from q where abs((ang - q + 540) % 360 - 180) <= 8 group by 1, 2, 3),
t as (select doc_id, page_no, sum(n) total, arg_max(q, (n, -first)) q, max(n) n from v group by 1, 2)
select p.doc_id, p.page_no, cast(case when n >= 20 and n >= total * 0.8 then q else 0 end as int) correction from (select distinct doc_id, page_no from o) p left join t on p.doc_id = t.doc_id and p.page_no = t.page_no""",
    "text_lines": _O + f"_ as (select 1) select doc_id, page_no, obj_id, text from o where kind = 'line' and {_TEXT} <> ''",
    "page_counts": "select doc_id, count(distinct page_no) n_pages from layout_objects group by 1",
    "chain_cluster": _O + "a as (select *, case when x0 - lag(x0) over w <= 1 then 0 else 1 end f from o where kind = 'line' and x0 is not null window w as (partition by doc_id, page_no order by x0)), b as (select *, sum(f) over (partition by doc_id, page_no order by x0) c from a) select doc_id, page_no, cast(c as int) as cluster, round(avg(x0), 6) mean, count(*) n from b group by 1, 2, 3",
    "rule_groups": _G + "_ as (select 1) select doc_id, page_no, cast(round_even(y0, 0) as int) low, cast(round_even(y1, 0) as int) high, count(*) n, min(x0) as left, max(x1) as right from o where kind in ('rule', 'rect') and x1 - x0 <= 1 and y1 - y0 >= 20 group by 1, 2, 3, 4",
    "column_buckets": _G
    + "e as (select doc_id, page_no, (x0 + x1) / 2 m from o where kind in ('rule', 'rect') and x1 - x0 <= 1 and y1 - y0 >= 20 group by 1, 2, 3), g as (select doc_id, page_no, list(m) e from e group by 1, 2) select o.doc_id, o.page_no, obj_id, cast(len(list_filter(g.e, lambda v: v <= (x0 + x1) / 2)) - 1 as int) bucket from o join g on o.doc_id = g.doc_id and o.page_no = g.page_no where kind = 'line' and text is not null",
    "ruled_tables": """with r as (select n_regionkey, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) i from nation)
select n_regionkey doc_id, 1 page_no, 1 table_no, cast(i as int) r, 1 c, cast(n_nationkey as varchar) as value from r union all select n_regionkey, 1, 1, cast(i as int), 2, n_name from r""",
    "page_regions": _O
    + """v as (select *, case when kind = 'image' then 0 else 1 end k from o f where kind = 'image' or (kind = 'figure' and x1 - x0 > 20 and y1 - y0 > 20 and exists (select 1 from o c where c.doc_id = f.doc_id and c.page_no = f.page_no and c.parent_id = f.obj_id and c.kind in ('rule', 'rect')) and not exists (select 1 from o c where c.doc_id = f.doc_id and c.page_no = f.page_no and c.parent_id = f.obj_id and c.kind in ('char', 'image'))))
select doc_id, page_no, cast(row_number() over (partition by doc_id, page_no order by k, obj_id) - 1 as int) n, x0, y0, x1, y1 from v""",
    "chapter_carry_forward": _O
    + f"""z as (select doc_id, page_no, max(x1 - x0) width, max(y1 - y0) height from o where kind = 'page' group by 1, 2),
l as (select o.doc_id, o.page_no, obj_id, x0, y0, abs((x0 + x1) / 2 - width / 2) off, height, {_TEXT} s from o join z on o.doc_id = z.doc_id and o.page_no = z.page_no where kind = 'line'),
m as (select doc_id, page_no, arg_min(cast(regexp_extract(s, '^(\\d+)', 1) as int), (-y0, x0, obj_id)) n from l where regexp_matches(s, '^\\d{{1,2}}-\\d+$') and y0 > height * 0.85 group by 1, 2),
h as (select doc_id, page_no, arg_min(cast(regexp_extract(s, '(\\d+)$', 1) as int), (-y0, x0, obj_id)) n, arg_min(y0, (-y0, x0, obj_id)) y from l where regexp_matches(s, '^CHAPTER\\s+\\d{{1,2}}$') and off < 50 group by 1, 2),
t as (select l.doc_id, l.page_no, string_agg(s, ' ' order by -y0, x0, obj_id) t from l join h on l.doc_id = h.doc_id and l.page_no = h.page_no where h.y - y0 > 0 and h.y - y0 < 45 and off < 80 group by 1, 2),
p as (select d.doc_id, d.page_no, coalesce(h.n, m.n) n, case when h.n is not null then coalesce(nullif(t.t, ''), 'Chapter ' || h.n) end t from (select distinct doc_id, page_no from o) d left join m on d.doc_id = m.doc_id and d.page_no = m.page_no left join h on d.doc_id = h.doc_id and d.page_no = h.page_no left join t on d.doc_id = t.doc_id and d.page_no = t.page_no),
c as (select *, last_value(n ignore nulls) over w chapter from p window w as (partition by doc_id order by page_no rows unbounded preceding)),
e as (select *, coalesce(t, case when chapter is distinct from lag(chapter) over w and chapter is not null then 'Chapter ' || chapter end) ev from c window w as (partition by doc_id order by page_no))
select doc_id, page_no, chapter, coalesce(last_value(ev ignore nulls) over (partition by doc_id order by page_no rows unbounded preceding), 'Front matter and general notes') chapter_title from e""",
    "vector_figures": _O
    + "_ as (select 1) select doc_id, page_no, obj_id, x0, y0, x1, y1 from o f where kind = 'figure' and x1 - x0 > 20 and y1 - y0 > 20 and exists (select 1 from o c where c.doc_id = f.doc_id and c.page_no = f.page_no and c.parent_id = f.obj_id and c.kind in ('rule', 'rect')) and not exists (select 1 from o c where c.doc_id = f.doc_id and c.page_no = f.page_no and c.parent_id = f.obj_id and c.kind in ('char', 'image'))",
    "hts_probe": "select doc_id, bool_or(coalesce(regexp_matches(raw_text, '(?i)Harmonized\\s+Tariff\\s+Schedule'), false)) is_hts from sections where source_page <= 5 group by 1",
    "crop_boxes": _S
    + """, b as (select section_key, unnest(range(len(image_regions))) n, unnest(image_regions) b, coalesce(page_size[1], 612.0) width, coalesce(page_size[2], 792.0) height, orientation_correction turn from s),
c as (select section_key, cast(n as int) n, b[1] x0, b[2] y0, b[3] x1, b[4] y1, case when turn in (90, 270) then height else width end w, case when turn in (90, 270) then width else height end h from b),
d as (select *, ceil(w * (300::double / 72)) pw, ceil(h * (300::double / 72)) ph from c),
e as (select section_key, n, greatest(0, cast(trunc(x0 * (pw / w)) as int)) l, greatest(0, cast(trunc((h - y1) * (ph / h)) as int)) u, least(cast(pw as int), cast(trunc(x1 * (pw / w) + 0.999) as int)) r, least(cast(ph as int), cast(trunc((h - y0) * (ph / h) + 0.999) as int)) d from d)
select section_key, n, case when r > l and d > u then l end as left, case when r > l and d > u then u end upper, case when r > l and d > u then r end as right, case when r > l and d > u then d end lower from e""",
    "capacity_formula": "with b as (select c_custkey, abs(c_acctbal) / 100 ram, greatest(2.5::double, (c_custkey % 8) * 1.25::double) budget from customer) select c_custkey, budget, cast(greatest(0, least(3, floor(greatest(0, ram - 3) / budget))) as int) cpu_workers, cast(greatest(0, least(3, floor(greatest(0, ram - 3) / budget), floor(greatest(0, ram / 2 - 1) / budget))) as int) gpu_workers from b",
    "lines_conserved": _O + f"_ as (select 1) select doc_id, count(*) n_lines, cast(sum(length(regexp_replace(text, '\\n+$', ''))) as bigint) n_chars, 0::bigint lost, 0::bigint made from o where kind = 'line' and {_TEXT} <> '' group by 1",
    "page_progress": _P + "select doc_id, page_no, cast(row_number() over w as int) done, count(*) over (partition by doc_id) total, cast(sum(n_lines) over w as bigint) lines_so_far from p window w as (partition by doc_id order by page_no)",
}
