"""Prose to titled sections: lines, headings, merged and dense headings, contents, short sections.

Input of the section operators is a line table (keys, ``line_no`` from 0, ``line``). All steps
are windows over the lines or headings of one document and grouped aggregates; nothing loops.

Defined results: a document without headings is one section "Content"; text before the first
heading is a section "Preamble" if it isn't blank; null texts have no lines and no sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X

MERGE_GAP, CLUSTER_GAP, MIN_CLUSTER, MIN_CONTENT = 4, 12, 4, 200
GLOSSARY_MARKER, GLOSSARY_DIVIDER = r"^[A-Z]-\d{1,3}$", r"^[\p{Lu}]$"


def text_lines(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), cleaned: bool = True) -> DataFrame:
    """keys, line_no from 0, line of each line of the (cleaned) text."""
    t = X.clean(F.col(text)) if cleaned else F.col(text)
    # outer: of an inner one the optimizer makes a filter on the array and so splits twice
    return df.select(*keys, F.posexplode_outer(X.splitlines(t)).alias("line_no", "line")).where(F.col("line_no").isNotNull())


def _blank(line: Column) -> Column:
    return X.strip(line) == ""


def _glossary_marks(name: str | None) -> tuple[Column, Column, Column]:
    """Of a line: whether it calls the document a glossary (or the file's name does), is a page marker, is a letter's divider."""
    s = X.strip(F.col("line"))
    by_name = F.lit(False) if name is None else F.coalesce(F.lower(name).contains("glossary"), F.lit(False))
    return (F.lower("line").contains("glossary") & (F.col("line_no") < 350)) | by_name, s.rlike(GLOSSARY_MARKER) & (F.col("line_no") < 2000), s.rlike(GLOSSARY_DIVIDER) & (F.col("line_no") < 2000)


def _is_glossary(word: Column, markers: Column, dividers: Column) -> Column:
    return word | ((markers >= 5) & (dividers >= 3))


def glossary_score(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), name: str | None = None) -> DataFrame:
    """keys, has_word, page_markers, letter_dividers, is_glossary of each document, from its first lines and, if a column holds it, its file's name."""
    word, marker, divider = _glossary_marks(name)
    out = lines.groupBy(*keys).agg(F.max(word).alias("has_word"), F.count_if(marker).alias("page_markers"), F.count_if(divider).alias("letter_dividers"))
    return out.withColumn("is_glossary", _is_glossary(F.col("has_word"), F.col("page_markers"), F.col("letter_dividers")))


def raw_headings(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), mode: str = "auto", name: str | None = None) -> DataFrame:
    """keys, line_no, title, filled (non-blank lines up to here) of each heading line. mode: auto, chapter or glossary."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    s = X.strip(F.col("line"))
    rows = lines.withColumn("_s", s).withColumn("_free", F.lag("_s", 1, "").over(w) == "").withColumn("filled", F.sum((F.col("_s") != "").cast("int")).over(w))
    glossary = F.lit(mode == "glossary")
    if mode == "auto":  # over the lines as they are partitioned already
        word, marker, divider = _glossary_marks(name)
        whole = Window.partitionBy(*keys)
        rows = rows.withColumn("_g", _is_glossary(F.max(word).over(whole), F.count_if(marker).over(whole), F.count_if(divider).over(whole)))
        glossary = F.col("_g")
    c = F.col("_s")
    marker, divider = glossary & c.rlike(GLOSSARY_MARKER), glossary & c.rlike(GLOSSARY_DIVIDER)
    heading = ~marker & (X.is_chapter_line(c) | (F.col("_free") & F.when(divider, F.lit(True)).otherwise(X.is_heading(c))))
    return rows.where(heading).select(*keys, "line_no", c.alias("title"), "filled")


def merged_headings(raw: DataFrame, keys: tuple[str, ...] = ("doc_id",), gap: int = MERGE_GAP) -> DataFrame:
    """keys, start, stop, title: heading lines with nothing but blank lines between, close together, are one."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    apart = (F.col("line_no") - F.lag("line_no").over(w) > gap) | (F.col("filled") - F.lag("filled").over(w) > 1)
    marked = raw.withColumn("_i", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w))
    return marked.groupBy(*keys, "_i").agg(F.min("line_no").alias("start"), F.max("line_no").alias("stop"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "title"))), lambda x: x["title"]), " ").alias("title")).drop("_i")


def sparse_headings(merged: DataFrame, keys: tuple[str, ...] = ("doc_id",), gap: int = CLUSTER_GAP, most: int = MIN_CLUSTER) -> DataFrame:
    """Without chains of ``most`` or more headings that follow each other within ``gap`` lines."""
    w = Window.partitionBy(*keys).orderBy("start")
    marked = merged.withColumn("_i", F.sum(F.coalesce(F.col("start") - F.lag("stop").over(w) > gap, F.lit(True)).cast("int")).over(w))
    return marked.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_i"))).where(F.col("_n") < most).drop("_i", "_n")


def section_contents(lines: DataFrame, headings: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, seq from 0, title, content of each section."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    marks = headings.select(*keys, F.col("start").alias("line_no"), F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.col("title").alias("_title"))
    rows = lines.join(marks, [*keys, "line_no"], "left")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    placed = rows.select(*keys, "line_no", "line", last("_start").alias("_start"), last("_stop").alias("_stop"), last("_title").alias("_title"))
    body = placed.withColumn("_in", F.col("_start").isNull() | (F.col("line_no") > F.col("_stop")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    parts = body.groupBy(*keys, "_start").agg(F.first("_title").alias("_title"), X.strip(joined).alias("content"))
    any_head = F.max("_start").over(Window.partitionBy(*keys)).isNotNull()
    named = parts.withColumn("title", F.when(F.col("_start").isNotNull(), F.col("_title")).when(any_head, F.lit("Preamble")).otherwise(F.lit("Content")))
    kept = named.where(F.col("_start").isNotNull() | (F.col("content") != "") | (F.col("title") == "Content"))
    order = Window.partitionBy(*keys).orderBy(F.col("_start").asc_nulls_first())
    return kept.select(*keys, (F.row_number().over(order) - 1).alias("seq"), "title", "content")


def smoothed(sections: DataFrame, keys: tuple[str, ...] = ("doc_id",), least: int = MIN_CONTENT) -> DataFrame:
    """Short sections join the one before; those at the start join the first that is long enough then."""
    w = Window.partitionBy(*keys).orderBy("seq")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    size, has = F.length("content"), (F.col("content") != "").cast("int")
    tsize, thas = F.length("title"), (F.col("title") != "").cast("int")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # length of everything up to here with the titles before it, one separator between parts that aren't empty
    reach = F.sum(size).over(up) + zero(F.sum(tsize).over(before)) + F.greatest(F.sum(has).over(up) + zero(F.sum(thas).over(before)) - 1, F.lit(0))
    rows = sections.withColumn("_reach", reach).withColumn("_last", F.max("seq").over(whole))
    rows = rows.withColumn("_head", F.coalesce(F.min(F.when(F.col("_reach") >= least, F.col("seq"))).over(whole), F.col("_last")))
    opens = (F.col("seq") > F.col("_head")) & (size >= least)
    rows = rows.withColumn("_g", F.sum(opens.cast("int")).over(w))
    # parts of a group in order: head titles backwards, head contents, then title and content of each that joins
    head = F.array(
        F.struct((F.lit(0) - F.col("seq")).alias("a"), F.lit(0).alias("b"), F.when(F.col("seq") < F.col("_head"), F.col("title")).otherwise("").alias("t")),
        F.struct((F.col("seq") + 1).alias("a"), F.lit(1).alias("b"), F.col("content").alias("t")),
    )
    tail = F.array(
        F.struct((F.col("seq") + 1).alias("a"), F.lit(0).alias("b"), F.when(opens, F.lit("")).otherwise(F.col("title")).alias("t")),
        F.struct((F.col("seq") + 1).alias("a"), F.lit(1).alias("b"), F.col("content").alias("t")),
    )
    rows = rows.withColumn("_p", F.when(F.col("seq") <= F.col("_head"), head).otherwise(tail))
    title = F.coalesce(F.max(F.when(F.col("seq") == F.col("_head"), F.col("title"))), F.min_by("title", "seq"))
    parts = F.array_sort(F.flatten(F.collect_list("_p")))
    text = F.array_join(F.transform(F.filter(parts, lambda x: x["t"] != ""), lambda x: x["t"]), "\n")
    grouped = rows.groupBy(*keys, "_g").agg(title.alias("title"), X.strip(text).alias("content"))
    return grouped.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("_g")) - 1).alias("seq"), "title", "content")


def detect(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), mode: str = "auto", name: str | None = None) -> DataFrame:
    """The sections of each document: headings merged and thinned, contents, short ones joined. ``name``: a column with the file's name, which may call it a glossary."""
    heads = sparse_headings(merged_headings(raw_headings(lines, keys, mode, name), keys), keys)
    return smoothed(section_contents(lines, heads, keys), keys)


def numbered(sections: DataFrame, chapter: Column, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds id: chapter and place from 1."""
    return sections.withColumn("id", F.concat(chapter.cast("string"), F.lit("."), (F.col("seq") + 1).cast("string")))


def document_title(sections: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, title: that of the first chapter line without its prefix, else the first title."""
    is_chapter = X.is_chapter_line(F.col("title"))
    first = F.min_by("title", "seq")
    chapter = F.min_by(F.when(is_chapter, F.col("title")), F.when(is_chapter, F.col("seq")))
    bare = X.strip(X.collapse(F.regexp_replace("_c", rf"(?i)^Chapter{X.WS}+\d+[\s:\x{{2013}}\-]+", "")))
    rows = sections.groupBy(*keys).agg(first.alias("_f"), chapter.alias("_c"))
    return rows.select(*keys, F.coalesce(F.coalesce(F.nullif(bare, F.lit("")), F.col("_c")), X.strip(X.collapse(F.col("_f"))), F.lit("Unknown")).alias("title"))


def validation(sections: DataFrame, keys: tuple[str, ...] = ("doc_id",), issues: str | None = None, page: str | None = None, versioned: bool = False, documents: DataFrame | None = None) -> DataFrame:
    """keys, warning: what is odd about each document's sections (id, title, content); with ``documents`` (keys), those without any too."""
    count = sections.groupBy(*keys).agg(F.count("*").alias("n"))
    few = count.where((F.col("n") < 2) & F.lit(not versioned)).select(*keys, F.concat(F.lit("WARNING: Only "), F.col("n").cast("string"), F.lit(" section detected. Expected at least 2.")).alias("warning"))
    short = sections.where((F.length("content") < MIN_CONTENT) & (F.lit(True) if page is None else F.col(page).isNull()))
    short = short.select(*keys, F.concat(F.lit("WARNING: Section '"), F.col("id"), F.lit(" – "), F.col("title"), F.lit("' is unusually short ("), F.length("content").cast("string"), F.lit(" chars).")).alias("warning"))
    out = few.unionByName(short)
    if documents is not None:
        none = documents.select(*keys).distinct().join(sections.select(*keys), list(keys), "left_anti")
        out = out.unionByName(none.select(*keys, F.lit("WARNING: No headings were detected in the document.").alias("warning")))
    if issues:
        out = out.unionByName(sections.select(*keys, F.explode(issues).alias("_i"), "id").select(*keys, F.concat(F.lit("WARNING: "), F.col("id"), F.lit(": "), F.col("_i")).alias("warning")))
    return out


_LINE = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("s", T.StringType())])
_LINE_ARROW = pa.struct([("line_no", pa.int32()), ("s", pa.string())])
_CHAPTER = re.compile(X.CHAPTER.replace(X.WS, r"\s"))


def _joined_run(lines: list[dict]) -> list[dict]:
    """The lines of a run between blank ones, those that go on joined; ``alone`` ones begin and end a line."""
    out: list[dict] = []
    parts: list[str] = []  # of the line being joined; its last character, its length and its start are all that later lines ask for
    size, alone = 0, True

    def close() -> None:
        if parts:
            out.append({"line_no": first, "s": "".join(parts)})

    first = None
    for x in lines:
        s = x["s"]
        end = parts[-1][-1:] if parts else ""
        free = bool(parts) and s != "" and size > 0 and not alone and not x["alone"]
        if free and end == "-" and s[0].isalnum():
            parts[-1] = parts[-1][:-1]
            parts.append(s)
            size += len(s) - 1
        elif free and end not in ".!?:;" and (s[0].islower() or end in ",(/" or size >= 60):
            parts += [" ", s]
            size += 1 + len(s)
        else:
            close()
            first, parts, size, alone = x["line_no"], [s], len(s), x["alone"]
            continue
        # two lines may make the beginning of a chapter between them
        alone = bool(_CHAPTER.match("".join(parts[:5])))
    close()
    return out


@F.arrow_udf(T.ArrayType(_LINE))
def _joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([_joined_run(x or []) for x in b.to_pylist()], pa.list_(_LINE_ARROW))


def joined_lines(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, line_no, line: wrapped lines joined, cut words without their hyphen.

    Whether a line goes on depends on the joined text only by its length of 60 or more, its end and its first mark; these are carried along within each run between blank lines; a null line is a blank one."""
    s = F.coalesce(X.strip(F.col("line")), F.lit(""))
    rows = lines.select(*keys, "line_no", s.alias("s"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    run = F.sum(((F.col("s") == "") | (F.lag("s", 1, "").over(w) == "")).cast("int")).over(w)
    item = F.struct("line_no", "s", (X.is_bullet(F.col("s")) | X.is_table_row(F.col("s")) | X.is_chapter_line(F.col("s"))).alias("alone"))
    runs = rows.withColumn("_r", run).groupBy(*keys, "_r").agg(F.array_sort(F.collect_list(item)).alias("l"))
    folded = runs.withColumn("_j", _joined("l")).select(*keys, F.explode("_j").alias("x"))
    return folded.select(*keys, "x.line_no", X.strip(X.collapse(F.col("x.s"))).alias("line"))


def table_blocks(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), least: int = 3) -> DataFrame:
    """keys, block, first_line, last_line, n_rows, n_cols, consistent of each run of table rows (single blank lines within)."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    rows = lines.where(X.is_table_row(F.col("line"))).select(*keys, "line_no", F.size(X.cells(F.col("line"))).alias("cols"))
    filled = lines.select(*keys, "line_no", F.sum((~_blank(F.col("line"))).cast("int")).over(w).alias("filled"))
    near = rows.join(filled, [*keys, "line_no"])
    apart = (F.col("line_no") - F.lag("line_no").over(w) > 2) | (F.col("filled") - F.lag("filled").over(w) > 1)
    runs = near.withColumn("_b", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w))
    counts = runs.groupBy(*keys, "_b", "cols").agg(F.count("*").alias("k"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    # the most frequent number of columns; of equals the smaller
    blocks = counts.groupBy(*keys, "_b").agg(F.min("lo").alias("first_line"), F.max("hi").alias("last_line"), F.sum("k").alias("n_rows"), F.max_by("cols", F.struct("k", -F.col("cols"))).alias("n_cols"))
    within = counts.join(blocks.select(*keys, "_b", "n_cols"), [*keys, "_b"]).groupBy(*keys, "_b").agg(F.sum(F.when(F.abs(F.col("cols") - F.col("n_cols")) <= 1, F.col("k")).otherwise(0)).alias("near"))
    done = blocks.join(within, [*keys, "_b"]).where(F.col("n_rows") >= least)
    return done.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("first_line")).alias("block"), "first_line", "last_line", "n_rows", "n_cols", (F.col("near") >= F.greatest(F.lit(3), F.floor(F.col("n_rows") * 0.6))).alias("consistent"))


def normal_block(rows: Column) -> Column:
    """Lines of a table block (an array of arrays of cells): with its header's labels if the first row is one, else row by row."""
    one = lambda c: X.strip(X.collapse(c))
    first = F.get(rows, 0)
    header = ~F.exists(first, lambda c: c.rlike(r"\p{Nd}")) & (F.size(F.filter(first, lambda c: c.rlike(r"\p{L}"))) >= F.greatest(F.lit(2), F.size(first) - 1))
    labels = F.transform(first, lambda c, i: F.coalesce(F.nullif(F.regexp_replace(one(c), ":+$", ""), F.lit("")), F.concat(F.lit("col_"), (i + 1).cast("string"))))
    label = lambda i: F.coalesce(F.get(labels, i), F.concat(F.lit("col_"), (i + 1).cast("string")))
    with_header = F.concat(F.array(F.concat(F.lit("Table columns: "), F.array_join(labels, " | "))), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.concat(F.lit("- "), F.array_join(F.transform(r, lambda c, i: F.concat(label(i), F.lit(": "), one(c))), "; "))))
    plain = F.concat(F.array(F.lit("Table rows:")), F.transform(rows, lambda r: F.concat(F.lit("- "), F.array_join(F.transform(r, one), " | "))))
    return F.when(header, with_header).otherwise(plain)
