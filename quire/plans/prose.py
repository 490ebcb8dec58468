"""Queries on prose: lines and their kinds, headings, sections, names, page lists; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import sections as S
from quire.sources.tables import table

WS = X.WS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "file_name", "source", "page_count")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return S.text_lines(documents(spark, folder))


_CLEAN = strip(r"regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(12), chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")
_LINES = f"""
with lc as (select doc_id, {_CLEAN} t from documents where text is not null),
la as (select doc_id, regexp_split_to_array(t, '{X.LINE_END}') p from lc),
lb as (select doc_id, case when p[len(p)] = '' then p[1:len(p) - 1] else p end p from la),
l0 as (select doc_id, cast(unnest(range(len(p))) as int) line_no, unnest(p) line from lb),
l as (select *, {strip("line")} s from l0)
"""
_MINOR = ", ".join(f"'{w}'" for w in X.MINOR_WORDS)
_WORDS = f"list_filter(regexp_split_to_array(s, '{WS}+'), lambda w: w <> '')"
_TITLE = f"""(coalesce(regexp_matches(({_WORDS})[1], '^[\\p{{Lu}}\\p{{Lt}}]'), false) and len(list_filter(list_transform(({_WORDS})[2:], lambda w: regexp_replace(w, '^[''"]+|[''"]+$', '', 'g')), lambda w: regexp_matches(w, '^\\p{{L}}') and lower(w) not in ({_MINOR}) and not regexp_matches(w, '^[\\p{{Lu}}\\p{{Lt}}]'))) = 0)"""
_CAPS = r"(s = upper(s) and regexp_matches(s, '\p{L}'))"
_HEADING = f"""(regexp_matches(s, '^[\\p{{L}}\\p{{N}}]') and length(s) between 3 and 120 and not contains(s, '.') and not contains(s, ':') and not regexp_matches(s, '{X.FIGURE_CAPTION}') and not regexp_matches(s, '{X.PAGE_NUMBER}') and ({_TITLE} or {_CAPS}))"""
_CELLS = rf"list_filter(list_transform(regexp_split_to_array(s, '{X.CELL_GAP}'), lambda x: {strip('x')}), lambda x: x <> '')"
_BULLET = f"regexp_matches(s, '{X.BULLET}')"
_ROW = f"(s <> '' and not {_BULLET} and len({_CELLS}) >= 2)"
_ART = rf"(s <> '' and (regexp_matches(s, '{X.IMAGE_WORD}') or regexp_matches(s, '{X.DRAWING}') or (len(regexp_extract_all(s, '\p{{L}}')) <= 2 and len(regexp_extract_all(s, '{X.SYMBOLS}')) >= greatest(4, length(s) // 2))))"


def doc_line_profile(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document: how many lines of which kind its cleaned text has. Counted within the row, without a shuffle."""
    parts = documents(spark, folder).where(F.col("text").isNotNull()).select("doc_id", X.splitlines(X.clean(F.col("text"))).alias("p"))
    n = lambda keep: F.size(F.filter("p", keep)).cast("bigint")
    free = lambda x, i: F.when(i == 0, F.lit("")).otherwise(X.strip(F.get("p", i - 1))) == ""
    return parts.select("doc_id", F.size("p").cast("bigint").alias("n_lines"), n(lambda x: X.strip(x) == "").alias("n_blank"), n(X.is_bullet).alias("n_bullets"), n(lambda x, i: X.is_heading(x) & free(x, i)).alias("n_headings"))


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", X.clean(F.col("text")).alias("cleaned"))


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder)


def line_frequency_top(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most frequent lines of the corpus (a report), with the first place they stand."""
    s = lines(spark, folder).withColumn("s", X.strip(F.col("line"))).where("s <> ''")
    counted = s.groupBy(F.col("s").alias("line")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("f"))
    return counted.orderBy(F.desc("n"), "f", "line").limit(20).select("line", "n", F.col("f.doc_id").alias("first_doc"), F.col("f.line_no").alias("first_line"))


def repeated_line_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency_top(spark, folder).where((F.col("n") >= 3) & (F.length("line") < 120)).select("line", "n")


#: Kinds that are of pages rather than of prose: looked for in the raw text of sections.
PAGE_KINDS = ("cid_lines", "page_number_lines")


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "sections").select("section_key", "raw_text").dropDuplicates(["section_key"])
    return S.text_lines(pages, "raw_text", ("section_key",))


def _kind(name: str, keep) -> object:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows, key = (page_lines(spark, folder), "section_key") if name in PAGE_KINDS else (lines(spark, folder), "doc_id")
        return rows.where(keep(X.strip(F.col("line")))).select(key, "line_no", "line")

    query.__name__ = name
    return query


KINDS = {
    "bullet_lines": (X.is_bullet, _BULLET),
    "table_row_lines": (X.is_table_row, _ROW),
    "page_number_lines": (X.is_page_number, f"regexp_matches(s, '{X.PAGE_NUMBER}')"),
    "chapter_lines": (X.is_chapter_line, f"regexp_matches(s, '{X.CHAPTER}')"),
    "cid_lines": (lambda s: s.rlike(X.CID), f"regexp_matches(s, '{X.CID}')"),
    "title_case_lines": (lambda s: (s != "") & X.is_title_case(s), f"s <> '' and {_TITLE}"),
    "allcaps_lines": (X.is_all_caps, _CAPS),
    "heading_shape_lines": (X.is_heading, _HEADING),
}


def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Heading lines after a blank line or at the start."""
    return S.raw_headings(lines(spark, folder), mode="chapter").select("doc_id", "line_no", "title")


_RAW = f"""h as (select doc_id, line_no, s as title, filled from (select *, coalesce(lag(s) over w, '') = '' free, sum(case when s <> '' then 1 else 0 end) over w filled from l window w as (partition by doc_id order by line_no))
  where regexp_matches(s, '{X.CHAPTER}') or (free and {_HEADING}))"""


def glossary_score(spark: SparkSession, folder: str) -> DataFrame:
    return S.glossary_score(lines(spark, folder)).select("doc_id", "has_word", "page_markers", "letter_dividers", "is_glossary")


def file_chapters(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", X.stem(F.col("file_name")).alias("stem"), X.chapter_number(F.col("file_name")).alias("chapter"), X.output_base(F.lit(""), F.col("file_name")).alias("output_base"))


def page_lists(spark: SparkSession, folder: str) -> DataFrame:
    """A page list of each document ('1,2-n,1') and what it stands for."""
    spec = F.concat(F.lit("1, 2-"), F.greatest(F.col("page_count"), F.lit(2)).cast("string"), F.lit(",1"))
    rows = documents(spark, folder).where("page_count is not null").select("doc_id", spec.alias("spec"))
    pages = X.page_list(F.col("spec"))
    return rows.select("doc_id", "spec", F.size(pages).alias("n_pages"), F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"), X.page_list_valid(F.concat("spec", F.lit(",5-1"))).alias("descending_valid"))


# Lines with many headings, made of the table part: a book a brand.
_BOOKS = """
with p as (select *, row_number() over (partition by p_brand order by p_partkey) rn from {part}),
l as (
 select p_brand book, rn, 0 k, '' line from p
 union all select p_brand, rn, 1, concat(p_type, ' PART ', cast(p_partkey as {text})) from p
 union all select p_brand, rn, 2, '' from p
 union all select p_brand, rn, 3, 'Second Line of the Title' from p where p_partkey % 7 = 0
 union all select p_brand, rn, 4, '' from p
 union all select p_brand, rn, 4+j, concat('item ', cast(j as {text}), ' of ', p_name, ', priced.') from (select *, {each} j from p))
select book, cast(row_number() over (partition by book order by rn, k) - 1 as int) line_no, line from l
"""


def books(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return spark.sql(_BOOKS.replace("{text}", "string").replace("{each}", "explode(sequence(1, p_size))"), part=part)


BOOK = ("book",)


def sections_raw(spark: SparkSession, folder: str) -> DataFrame:
    return S.merged_headings(S.raw_headings(books(spark, folder), BOOK, "chapter"), BOOK)


def cluster_drop(spark: SparkSession, folder: str) -> DataFrame:
    return S.sparse_headings(sections_raw(spark, folder), BOOK).select("book", "start", "stop", "title")


def section_content(spark: SparkSession, folder: str) -> DataFrame:
    rows = books(spark, folder)
    return S.section_contents(rows, S.sparse_headings(S.merged_headings(S.raw_headings(rows, BOOK, "chapter"), BOOK), BOOK), BOOK)


def smoothed_sections(spark: SparkSession, folder: str) -> DataFrame:
    return S.smoothed(section_content(spark, folder), BOOK)


def section_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return S.numbered(smoothed_sections(spark, folder), F.regexp_extract("book", r"(\d+)", 1), BOOK).select("book", "seq", "id", "title")


def build_title(spark: SparkSession, folder: str) -> DataFrame:
    return S.document_title(smoothed_sections(spark, folder), BOOK)


def validation_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return S.validation(S.numbered(section_content(spark, folder), F.regexp_extract("book", r"(\d+)", 1), BOOK), BOOK)


def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every document's text, glossaries told by themselves."""
    return S.detect(lines(spark, folder))


def document_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of every document, merged, without dense ones."""
    return S.sparse_headings(S.merged_headings(S.raw_headings(lines(spark, folder)))).select("doc_id", "start", "stop", "title")


def document_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's sections before short ones are joined."""
    rows = lines(spark, folder)
    return S.section_contents(rows, S.sparse_headings(S.merged_headings(S.raw_headings(rows))))


def _numbered_documents(spark: SparkSession, folder: str) -> DataFrame:
    chapters = table(spark, folder, "documents").select("doc_id", F.coalesce("chapter", F.lit(0)).alias("_chapter"))
    return S.numbered(document_sections(spark, folder).join(chapters, "doc_id"), F.col("_chapter")).drop("_chapter")


def document_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's sections with their numbers."""
    return _numbered_documents(spark, folder).select("doc_id", "seq", "id", "title")


def document_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's title by its sections."""
    return S.document_title(document_sections(spark, folder))


def document_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """What validation finds in every document, those without a section too."""
    return S.validation(_numbered_documents(spark, folder), documents=documents(spark, folder))


def wrapped_lines_joined(spark: SparkSession, folder: str) -> DataFrame:
    return S.joined_lines(lines(spark, folder))


def table_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of table rows in the layout text of pages."""
    pages = table(spark, folder, "sections").dropDuplicates(["section_key"]).select("section_key", "layout_text")
    return S.table_blocks(S.text_lines(pages, "layout_text", ("section_key",)), ("section_key",))


def normalised_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each such block as labelled lines."""
    keys = ("section_key",)
    pages = table(spark, folder, "sections").dropDuplicates(["section_key"]).select("section_key", "layout_text")
    rows = S.text_lines(pages, "layout_text", keys)
    blocks = S.table_blocks(rows, keys).where("consistent")
    w = Window.partitionBy("section_key").orderBy("line_no")
    marked = rows.join(blocks.select("section_key", F.col("first_line").alias("line_no"), F.col("last_line").alias("_to"), "block"), ["section_key", "line_no"], "left")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    inside = marked.withColumn("_b", last("block")).withColumn("_e", last("_to")).where((F.col("line_no") <= F.col("_e")) & X.is_table_row(F.col("line")))
    cells = inside.groupBy("section_key", F.col("_b").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", X.cells(F.col("line")).alias("c")))), lambda x: x["c"]).alias("rows"))
    return cells.select("section_key", "block", F.array_join(S.normal_block(F.col("rows")), "\n").alias("text"))


_QUERIES = (doc_line_profile, clean_text, doc_lines, line_frequency_top, repeated_line_candidates, heading_lines, glossary_score, file_chapters, page_lists, sections_raw, cluster_drop, section_content, smoothed_sections, section_numbers, build_title, validation_warnings, document_sections, document_headings, document_contents, document_numbers, document_titles, document_warnings, wrapped_lines_joined, table_blocks, normalised_blocks)
QUERIES = {q.__name__: q for q in _QUERIES} | {k: _kind(k, keep) for k, (keep, _) in KINDS.items()}

_PAGE_LINES = _LINES.replace("doc_id", "section_key").replace("text,", "raw_text,").replace("from documents where text is", "from (select distinct section_key, raw_text from sections) where raw_text is")
_TOP = _LINES + ", t as (select s as line, count(*) n, min(doc_id) first_doc, min_by(line_no, (doc_id, line_no)) first_line from l where s <> '' group by s order by n desc, first_doc, first_line, line limit 20)"
_B = _BOOKS.replace("{part}", "part").replace("{text}", "varchar").replace("{each}", "unnest(range(1, p_size + 1))")
_WINDOW = "partition by book order by line_no"
_BOOK_RAW = f"""
with b as ({_B}), l as (select *, {strip("line")} s from b),
w as (select *, coalesce(lag(s) over ({_WINDOW}), '') = '' free, sum(case when s <> '' then 1 else 0 end) over ({_WINDOW}) filled from l),
h as (select book, line_no, s title, filled from w where regexp_matches(s, '{X.CHAPTER}') or (free and {_HEADING})),
h1 as (select *, case when line_no - lag(line_no) over ({_WINDOW}) <= 4 and filled - lag(filled) over ({_WINDOW}) <= 1 then 0 else 1 end fresh from h),
h2 as (select *, sum(fresh) over ({_WINDOW}) i from h1),
m as (select book, min(line_no) start, max(line_no) stop, string_agg(title, ' ' order by line_no) title from h2 group by book, i),
m1 as (select *, case when start - lag(stop) over (partition by book order by start) <= 12 then 0 else 1 end fresh from m),
m2 as (select *, sum(fresh) over (partition by book order by start) i from m1),
k as (select book, start, stop, title from m2 qualify count(*) over (partition by book, i) < 4),
c0 as (select l.book, l.line_no, l.line, k.start, k.stop, k.title from l asof left join k on l.book = k.book and l.line_no >= k.start),
c1 as (select book, start, any_value(title) title, coalesce({strip("string_agg(case when start is null or line_no > stop then line end, chr(10) order by line_no)")}, '') content from c0 group by book, start),
c2 as (select book, start, case when start is not null then title when max(start) over (partition by book) is not null then 'Preamble' else 'Content' end title, content from c1),
c as (select book, cast(row_number() over (partition by book order by start nulls first) - 1 as int) seq, title, content from c2 where start is not null or content <> '' or title = 'Content'),
"""
_SMOOTH = (
    _BOOK_RAW
    + """r0 as (select *, sum(length(content)) over u + coalesce(sum(length(title)) over v, 0) + greatest(sum(case when content <> '' then 1 else 0 end) over u + coalesce(sum(case when title <> '' then 1 else 0 end) over v, 0) - 1, 0) reach
  from c window u as (partition by book order by seq rows unbounded preceding), v as (partition by book order by seq rows between unbounded preceding and 1 preceding)),
r1 as (select *, coalesce(min(case when reach >= 200 then seq end) over (partition by book), max(seq) over (partition by book)) head from r0),
r2 as (select *, sum(case when seq > head and length(content) >= 200 then 1 else 0 end) over (partition by book order by seq) g from r1),
parts as (
  select book, g, -seq a, 0 b, title t from r2 where seq < head union all select book, g, seq + 1, 1, content from r2 where seq <= head
  union all select book, g, seq + 1, 0, title from r2 where seq > head and length(content) < 200 union all select book, g, seq + 1, 1, content from r2 where seq > head),
names as (select book, g, coalesce(max(case when seq = head then title end), min_by(title, seq)) title from r2 group by book, g),
z0 as (select n.book, n.g, n.title, (select string_agg(t, chr(10) order by a, b) from parts p where p.book = n.book and p.g = n.g and t <> '') content from names n),
z as (select book, cast(row_number() over (partition by book order by g) - 1 as int) seq, title, """
    + strip("coalesce(content, '')")
    + " content from z0)\n"
)
_NUMBERED = "regexp_extract(book, '(\\d+)', 1) || '.' || cast(seq + 1 as varchar)"

_DOC_RAW = _BOOK_RAW.replace(_BOOK_RAW[: _BOOK_RAW.index("h1 as")], _LINES + rf""", g as (select doc_id, bool_or(contains(lower(line), 'glossary') and line_no < 350) or (count(*) filter (regexp_matches(s, '{S.GLOSSARY_MARKER}') and line_no < 2000) >= 5 and count(*) filter (regexp_matches(s, '{S.GLOSSARY_DIVIDER}') and line_no < 2000) >= 3) g from l group by 1),
w as (select l.*, g.g, coalesce(lag(s) over (partition by l.doc_id order by line_no), '') = '' free, sum(case when s <> '' then 1 else 0 end) over (partition by l.doc_id order by line_no) filled from l join g on l.doc_id = g.doc_id),
h as (select doc_id, line_no, s title, filled from w where not (g and regexp_matches(s, '{S.GLOSSARY_MARKER}')) and (regexp_matches(s, '{X.CHAPTER}') or (free and case when g and regexp_matches(s, '{S.GLOSSARY_DIVIDER}') then true else {_HEADING} end))),
""").replace("book", "doc_id")
_DOC_SMOOTH = _DOC_RAW + _SMOOTH[len(_BOOK_RAW) :].replace("book", "doc_id")
_BLOCK = _LINES.replace("doc_id", "section_key").replace("text,", "layout_text,").replace("from documents where text is", "from (select distinct section_key, layout_text from sections) where layout_text is") + f"""
, r as (select section_key, line_no, len({_CELLS}) cols from l where {_ROW}), f as (select section_key, line_no, sum(case when s <> '' then 1 else 0 end) over (partition by section_key order by line_no) filled from l),
n as (select r.*, f.filled from r join f on r.section_key = f.section_key and r.line_no = f.line_no),
n1 as (select *, case when line_no - lag(line_no) over v <= 2 and filled - lag(filled) over v <= 1 then 0 else 1 end fresh from n window v as (partition by section_key order by line_no)),
n2 as (select *, sum(fresh) over (partition by section_key order by line_no) b from n1), c as (select section_key, b, cols, count(*) k, min(line_no) lo, max(line_no) hi from n2 group by 1, 2, 3),
o as (select section_key, b, min(lo) first_line, max(hi) last_line, cast(sum(k) as bigint) n_rows, cast(arg_max(cols, (k, -cols)) as int) n_cols from c group by 1, 2), q as (select o.section_key, o.b, any_value(first_line) first_line, any_value(last_line) last_line, any_value(n_rows) n_rows, any_value(n_cols) n_cols, sum(case when abs(c.cols - o.n_cols) <= 1 then c.k else 0 end) near from o join c on c.section_key = o.section_key and c.b = o.b where n_rows >= 3 group by 1, 2)
select section_key, cast(row_number() over (partition by section_key order by first_line) as int) block, first_line, last_line, n_rows, n_cols, near >= greatest(3, floor(n_rows * 0.6)) consistent from q"""

SQL = {
    "document_sections": _DOC_SMOOTH + "select * from z",
    "table_blocks": _BLOCK,
    "doc_line_profile": _LINES + f", {_RAW.replace(f"regexp_matches(s, '{X.CHAPTER}') or ", '')} select lb.doc_id, cast(len(p) as bigint) n_lines, cast(coalesce(n_blank, 0) as bigint) n_blank, cast(coalesce(n_bullets, 0) as bigint) n_bullets, cast(coalesce(n_headings, 0) as bigint) n_headings from lb left join (select doc_id, count(*) filter (s = '') n_blank, count(*) filter ({_BULLET}) n_bullets from l group by 1) x on lb.doc_id = x.doc_id left join (select doc_id, count(*) n_headings from h group by 1) y on lb.doc_id = y.doc_id",
    "clean_text": f"select doc_id, {_CLEAN} cleaned from documents",
    "doc_lines": _LINES + "select doc_id, line_no, line from l",
    "line_frequency_top": _TOP + " select * from t",
    "repeated_line_candidates": _TOP + " select line, n from t where n >= 3 and length(line) < 120",
    "heading_lines": _LINES + f", {_RAW} select doc_id, line_no, title from h",
    "glossary_score": _LINES + rf", g as (select doc_id, bool_or(contains(lower(line), 'glossary') and line_no < 350) has_word, count(*) filter (regexp_matches(s, '{S.GLOSSARY_MARKER}') and line_no < 2000) page_markers, count(*) filter (regexp_matches(s, '{S.GLOSSARY_DIVIDER}') and line_no < 2000) letter_dividers from l group by 1) select *, has_word or (page_markers >= 5 and letter_dividers >= 3) is_glossary from g",
    "file_chapters": r"""
with s as (select doc_id, case when regexp_matches(f, '^.+\.[^.]*$') then regexp_extract(f, '^(.+)\.[^.]*$', 1) else f end stem from (select doc_id, regexp_extract(file_name, '([^/\\]*)$', 1) f from documents)),
n as (select *, coalesce(try_cast(nullif(regexp_extract(stem, '(?i)(?:^|[ _-])(?:chapter|ch)[ _-]*(\d+)(?:\D|$)', 1), '') as int), try_cast(nullif(regexp_extract(stem, '^(\d{1,3})$', 1), '') as int), 0) chapter from s)
select doc_id, stem, chapter, case when chapter > 0 then 'chapter_' || chapter || '_rag' else stem || '_rag' end output_base from n""",
    "page_lists": "select doc_id, '1, 2-' || n || ',1' spec, cast(n as int) n_pages, array_to_string(range(0, n), ',') pages, false descending_valid from (select doc_id, greatest(page_count, 2) n from documents where page_count is not null)",
    "sections_raw": _BOOK_RAW + "_ as (select 1) select * from m",
    "cluster_drop": _BOOK_RAW + "_ as (select 1) select * from k",
    "section_content": _BOOK_RAW + "_ as (select 1) select * from c",
    "smoothed_sections": _SMOOTH + "select * from z",
    "section_numbers": _SMOOTH + f"select book, seq, {_NUMBERED} id, title from z",
    "build_title": _SMOOTH + rf"select book, coalesce(min_by(case when regexp_matches(title, '{X.CHAPTER}') then regexp_replace(title, '(?i)^Chapter\s+\d+[\s:–-]+', '') end, case when regexp_matches(title, '{X.CHAPTER}') then seq end), {strip(f"regexp_replace(min_by(title, seq), '{WS}+', ' ', 'g')")}, 'Unknown') title from z group by book",
    "validation_warnings": _BOOK_RAW + f"_ as (select 1) select book, 'WARNING: Only ' || count(*) || ' section detected. Expected at least 2.' warning from c group by book having count(*) < 2 union all select book, 'WARNING: Section ''' || {_NUMBERED} || ' – ' || title || ''' is unusually short (' || length(content) || ' chars).' from c where length(content) < 200",
} | {k: _PAGE_LINES + f"select section_key, line_no, line from l where {sql}" if k in PAGE_KINDS else _LINES + f"select doc_id, line_no, line from l where {sql}" for k, (_, sql) in KINDS.items()}

_ID = "coalesce(d.chapter, 0) || '.' || cast(seq + 1 as varchar)"
SQL |= {
    "document_headings": _DOC_RAW + "_ as (select 1) select doc_id, start, stop, title from k",
    "document_contents": _DOC_RAW + "_ as (select 1) select * from c",
    "document_numbers": _DOC_SMOOTH + f"select z.doc_id, seq, {_ID} id, z.title from z join documents d on z.doc_id = d.doc_id",
    "document_titles": _DOC_SMOOTH + SQL["build_title"][len(_SMOOTH) :].replace("book", "doc_id"),
    "document_warnings": _DOC_SMOOTH
    + f"""select doc_id, 'WARNING: Only ' || count(*) || ' section detected. Expected at least 2.' as warning from z group by 1 having count(*) < 2
union all select z.doc_id, 'WARNING: Section ''' || {_ID} || ' – ' || z.title || ''' is unusually short (' || length(content) || ' chars).' from z join documents d on z.doc_id = d.doc_id where length(content) < 200
union all select doc_id, 'WARNING: No headings were detected in the document.' from documents where doc_id not in (select doc_id from z)""",
}
