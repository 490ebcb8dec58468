"""Conversion of files, end to end: PDF to JSON, Markdown, CSV or XLSX, with recovery and resume.

``python -m quire.plans.convert FILES --out FOLDER``, or ``--request job.json``.

Each file is decoded once and inspected once. Decoded objects and native page records are kept as
tables in a work folder under the digest of the file's bytes, so what a failed or a second run
finds there isn't made again; a table that can't be read counts as missing. Documents are named
by their path; files of one name in several folders stay apart.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.operators import grids, hts, html_tables, layout, recovery, render
from quire.operators import sections as S
from quire.plans import jobs
from quire.session import ship
from quire.sources import pdf, sinks

DOC_TYPES, ENGINES, FORMATS, WORKERS = ("auto", "chapter", "glossary"), ("native", "ocr"), ("json", "md", "both", "csv", "xlsx"), (1, 2, 3)
POLICY = json.dumps({"policy": "inline-v2", "scale": 300 / 72, "det": [0.2, 0.3, 1.2]})
#: Names the form of the kept tables; another form is another folder.
FORM = "v2"
OUT_OF_RANGE = "selected pages are out of range"


def documents(files: DataFrame) -> DataFrame:
    """doc_id (the path), digest, source (the file's name), stem: the name outputs take, with a piece of the digest where several files have one name."""
    named = files.select(F.col("path").alias("doc_id"), "digest", F.element_at(F.split("path", "/"), -1).alias("source"))
    several = named.groupBy(X.stem(F.col("source")).alias("_stem")).agg(F.count("*").alias("_n")).where("_n > 1")
    both = named.withColumn("_stem", X.stem(F.col("source"))).join(several, "_stem", "left")
    return both.select("doc_id", "digest", "source", F.when(F.col("_n").isNull(), F.col("_stem")).otherwise(F.concat("_stem", F.lit("_"), F.substring("digest", 1, 8))).alias("stem"))


class Kept:
    """A table of a work folder, in parts under the digests of files; parts are added whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, schema: T.StructType | str) -> DataFrame:
        # with a schema given, files that can't be read are left out, whatever of them is broken
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(self.path)

    def missing(self, files: DataFrame) -> DataFrame:
        """The files (digest ..) of which nothing is kept, each content once; all if there is no table yet."""
        once = files.dropDuplicates(["digest"])
        try:
            return once.join(self._table("digest string").distinct(), "digest", "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return once

    def add(self, rows: DataFrame) -> DataFrame:
        rows.write.mode("append").parquet(self.path)
        return self._table(rows.schema)


def decoded(files: DataFrame, kept: Kept, decoder: Callable = pdf.decode) -> DataFrame:
    """digest and layout objects of all pages of the files (path, digest, content); only what isn't kept is decoded."""
    todo = kept.missing(files)
    rows = pdf.layout_objects(todo.select(F.col("digest").alias("path"), "content"), decoder=decoder).withColumnRenamed("doc_id", "digest")
    return kept.add(rows).join(files.select("digest").distinct(), "digest", "left_semi")


def errors(objects: DataFrame) -> DataFrame:
    return objects.where("kind = 'error'").select("doc_id", F.col("text").alias("error"))


def sections(objects: DataFrame, doc_type: str = "auto") -> DataFrame:
    """One record a page, native content alone, of pages turned upright; tariff schedules with chapters and tariff rows.

    Whether a document is a schedule is told by its first five pages."""
    good = layout.objects(objects.where("kind <> 'error'"))
    turn = layout.orientation(good)
    good = layout.upright(good, turn)
    pages = layout.inspect(good).withColumn("content", F.col("raw_text"))
    tables = grids.extract(good).groupBy(*layout.PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "rows", "bbox"))), lambda t: F.struct(t["rows"].alias("rows"), t["bbox"].alias("bbox"))).alias("native_tables"))
    is_hts = hts.is_schedule(pages)
    chapters = layout.carried_chapters(good)
    tariff = hts.extract(good).select(*layout.PAGE, F.when(F.size("table_rows") > 0, hts.labelled(F.col("table_rows"))).alias("table_rows"))
    key = list(layout.PAGE)
    rows = pages.join(turn.withColumnRenamed("correction", "orientation_correction"), key, "left").join(tables, key, "left").join(is_hts, "doc_id", "left").join(chapters, key, "left").join(tariff, key, "left")
    h = F.coalesce("is_hts", F.lit(False))
    n = F.col("page_no").cast("string")
    title = F.when(h, F.concat("chapter_title", F.lit(" — PDF page "), n)).otherwise(F.concat(F.lit("PDF page "), n))
    tariff_rows = F.when(h, F.col("table_rows"))
    warnings = F.when(tariff_rows.isNotNull(), F.concat("warnings", F.array(F.lit(hts.ROW_NOTICE)))).otherwise(F.col("warnings"))
    return rows.select(
        *key, F.concat(F.lit("page-"), n).alias("id"), title.alias("title"), F.when(h, F.col("chapter")).alias("chapter"), F.when(h, F.col("chapter_title")).alias("chapter_title"), h.alias("is_hts"), F.when(h, F.col("layout_text")).otherwise(F.col("content")).alias("content"), "raw_text", "layout_text", "source_lines", "page_size",
        "orientation_correction", "image_count", "image_regions", "reading_order", warnings.alias("warnings"), "native_tables", tariff_rows.alias("table_rows"), F.when(tariff_rows.isNotNull(), F.lit(hts.ROW_SEMANTICS)).alias("table_row_semantics"), F.size(F.coalesce("native_tables", F.array())).alias("n_tables"),
    )


def native_pages(objects: DataFrame, files: DataFrame, kept: Kept) -> DataFrame:
    """digest and page records of the files (digest); only files without kept records are inspected."""
    todo = kept.missing(files.select("digest"))
    own = objects.join(todo, "digest", "left_semi").withColumnRenamed("digest", "doc_id")
    return kept.add(sections(own).withColumnRenamed("doc_id", "digest")).join(files.select("digest").distinct(), "digest", "left_semi")


def recovered(rows: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Sections with flags, ordered blocks and content after recognition (or with its flags pending)."""
    results = rows.sparkSession.createDataFrame([], recovery.RESULTS.replace("bigint", "string")) if results is None else results
    shaped = results.select(*recovery.REGION, "markdown", "raw", F.col("status").alias("result_status"))
    flags = recovery.resolved(recovery.flags(rows), shaped)
    native = rows.select(*layout.PAGE, F.posexplode("source_lines").alias("ordinal", "l")).select(*layout.PAGE, "ordinal", F.col("l.bbox").alias("bbox"), F.col("l.text").alias("text"))
    pages = recovery.rendered(recovery.blocks(native, flags)).withColumnRenamed("content", "_c")
    noted = F.flatten(F.transform("q", lambda x: F.transform(F.coalesce(x["quality_warnings"], F.array().cast("array<string>")), lambda w: F.format_string("Image %d: %s", x["region"], w))))
    per = flags.groupBy(*layout.PAGE).agg(F.array_sort(F.collect_list(F.struct("region", "flag_id", "status", "bbox", "image_sequence", "quality_warnings", "detail", "text", "accuracy_verified"))).alias("q"), F.min(F.col("status") == "converted").alias("_all")).withColumn("_n", noted)
    both = rows.join(per, list(layout.PAGE), "left").join(pages, list(layout.PAGE), "left")
    warned = F.when(F.col("q").isNotNull(), recovery.page_warnings(F.col("warnings"), F.col("_n"), F.col("_all"))).otherwise(F.col("warnings"))
    return both.withColumn("warnings", warned).withColumn("content", F.coalesce("_c", "content")).withColumnRenamed("q", "ocr_flags").drop("_c", "_n", "_all")


def labels(rows: DataFrame) -> tuple[Column, Column]:
    """A document's source and stem: its columns where it has them, else from its id."""
    source = F.col("source") if "source" in rows.columns else F.element_at(F.split("doc_id", "/"), -1)
    return source, F.col("stem") if "stem" in rows.columns else X.stem(source)


def markdown_documents(rows: DataFrame) -> DataFrame:
    """doc_id, source, stem, markdown."""
    source, stem = labels(rows)
    blocks = F.transform(F.col("ordered_blocks"), lambda b: F.struct(b["kind"].alias("kind"), F.coalesce(b["text"], F.lit("")).alias("text"), b["flag_id"].alias("flag_id")))
    title = F.when(F.col("is_hts"), F.lit(hts.DOCUMENT_TITLE)).otherwise(X.stem(source))
    readable = rows.withColumn("_md", render.section_markdown(F.col("id"), F.col("title"), F.col("warnings"), F.coalesce("layout_text", "content"), F.lit(None).cast("string"), blocks))
    return render.documents_markdown(readable.select("doc_id", source.alias("source"), stem.alias("stem"), F.col("page_no").alias("seq"), F.col("_md").alias("section_markdown"), title.alias("title")), keys=("doc_id", "source", "stem"))


def json_documents(rows: DataFrame, doc_type: str = "auto") -> DataFrame:
    """doc_id, source, stem, json: a document with its pages, indented, null keys left out but for the chapter."""
    source, stem = labels(rows)
    images = F.filter(F.coalesce("ocr_flags", F.array()), lambda f: f["status"] == "converted")
    image_ocr = F.transform(images, lambda f: F.struct(f["region"].alias("region"), f["bbox"].alias("bbox"), f["text"].alias("markdown"), f["accuracy_verified"].alias("accuracy_verified"), f["quality_warnings"].alias("quality_warnings"), f["status"].alias("status")))
    page = F.struct(
        "id", "title", F.col("page_no").alias("source_page"), "chapter", "chapter_title", "content", F.array().cast("array<string>").alias("tags"), "raw_text", "layout_text", "source_lines", "page_size", "orientation_correction", "image_count", "image_regions", "reading_order", "warnings", "native_tables", "table_rows", "table_row_semantics",
        "ocr_flags", F.when(F.size(image_ocr) > 0, image_ocr).alias("image_ocr"), "ordered_blocks",
    )
    odd = (F.size("warnings") > 0) | F.exists(F.coalesce("ocr_flags", F.array()), lambda f: f["status"] != "converted")
    docs = rows.groupBy("doc_id", source.alias("source"), stem.alias("stem")).agg(F.array_sort(F.collect_list(F.struct("page_no", page.alias("p")))).alias("s"), F.max(odd).alias("review"), F.max("is_hts").alias("is_hts"), F.max(F.col("ocr_flags").isNotNull()).alias("flagged"))

    def write(batches):
        import pyarrow as pa

        names = ("doc_id", "source", "stem", "json")
        for b in batches:
            d = b.to_pylist()
            text = [_document(r, doc_type) for r in d]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in d], pa.string()) for k in names[:3]), pa.array(text, pa.string())], names=names)

    return docs.mapInArrow(write, "doc_id string, source string, stem string, json string")


def _document(r: dict, doc_type: str) -> str:
    method = "native layout; no OCR" + ("; ordered native text with flagged inline OCR recovery" if r["flagged"] else "")
    out = {"schema_version": 2, "document_type": "hts" if r["is_hts"] else "pdf", "chapter": None, "title": hts.DOCUMENT_TITLE if r["is_hts"] else r["source"].rsplit(".", 1)[0], "source": r["source"], "extraction_method": method, "sections": [p["p"] for p in r["s"]], "review_required": bool(r["review"])}
    return render.document_json(out if r["is_hts"] else out | {"requested_doc_type": doc_type})


def page_grids(rows: DataFrame) -> DataFrame:
    """doc_id, source, stem, page_no, rows, merges: native tables and flagged regions of a page stacked from the top left."""
    grid = "struct<top:double,left:double,k:int,n:int,rows:array<array<string>>,merges:array<struct<r1:int,c1:int,r2:int,c2:int>>>"
    none = F.array().cast("array<struct<r1:int,c1:int,r2:int,c2:int>>")
    native = rows.select(*layout.PAGE, F.posexplode("native_tables").alias("n", "t")).select(*layout.PAGE, F.struct((-F.get("t.bbox", 3)).alias("top"), F.get("t.bbox", 0).alias("left"), F.lit(0).alias("k"), "n", F.col("t.rows").alias("rows"), none.alias("merges")).cast(grid).alias("b"))
    flags = rows.select(*layout.PAGE, F.explode("ocr_flags").alias("f")).withColumn("_g", html_tables.stacked("f.text"))
    done = F.col("f.status") == "converted"
    ocr = flags.select(*layout.PAGE, F.struct((-F.get("f.bbox", 3)).alias("top"), F.get("f.bbox", 0).alias("left"), F.lit(1).alias("k"), F.col("f.region").alias("n"), F.when(done, F.col("_g.rows")).otherwise(F.array(F.array("f.text"))).alias("rows"), F.when(done, F.col("_g.merges")).otherwise(none).alias("merges")).cast(grid).alias("b"))
    pages = native.unionByName(ocr).groupBy(*layout.PAGE).agg(F.array_sort(F.collect_list("b")).alias("b"))
    before = lambda i: F.aggregate(F.slice("b", F.lit(1), i), F.lit(0), lambda a, x: a + F.size(x["rows"]))
    shifted = F.flatten(F.transform("b", lambda x, i: F.transform(x["merges"], lambda m: F.struct((m["r1"] + before(i)).alias("r1"), m["c1"].alias("c1"), (m["r2"] + before(i)).alias("r2"), m["c2"].alias("c2")))))
    source, stem = labels(rows)
    named = rows.select(*layout.PAGE, source.alias("source"), stem.alias("stem"))
    return pages.join(named, list(layout.PAGE)).select(*layout.PAGE, "source", "stem", F.flatten(F.transform("b", lambda x: x["rows"])).alias("rows"), shifted.alias("merges"))


def write(rows: DataFrame, folder: str, fmt: str, name: str = "", doc_type: str = "auto") -> DataFrame:
    """Writes the files of a format; path and bytes of each (an action on it writes). A given name holds for tables too."""
    out = None
    given = F.nullif(F.regexp_replace(X.strip(F.lit(name)), r"(?i)\.(json|md|csv|xlsx)$", ""), F.lit(""))
    base = X.output_base(F.lit(name), F.concat("stem", F.lit(".pdf")))
    tables = F.coalesce(given, F.concat("stem", F.lit("_tables")))
    for kind in sinks.formats(fmt):
        if kind == "json":
            part = sinks.write_files(json_documents(rows, doc_type).withColumn("f", F.concat(base, F.lit(".json"))), folder, "f", "json")
        elif kind == "md":
            part = sinks.write_files(markdown_documents(rows).withColumn("f", F.concat(base, F.lit(".md"))), folder, "f", "markdown")
        elif kind == "csv":
            files = page_grids(rows).withColumn("file_name", F.concat(tables, F.format_string("_page-%d-table-1.csv", "page_no")))
            part = sinks.write_csv_tables(files, folder)
        else:
            sheet = F.struct("page_no", F.format_string("page-%d-table-1", "page_no").alias("name"), "rows", "merges")
            books = page_grids(rows).groupBy("doc_id", "stem").agg(F.array_sort(F.collect_list(sheet)).alias("sheets")).withColumn("file_name", F.concat(tables, F.lit(".xlsx")))
            part = sinks.write_workbooks(books, folder)
        out = part if out is None else out.unionByName(part)
    return out


def _flag(f: Column, page: Column) -> Column:
    """A flag as manifests and reports show it."""
    return F.struct(f["flag_id"].alias("id"), page.alias("source_page"), f["bbox"].alias("bbox"), f["status"].alias("status"), F.lit(recovery.REASON).alias("reason"), f["image_sequence"].alias("image_sequence"), f["accuracy_verified"].alias("accuracy_verified"), f["quality_warnings"].alias("quality_warnings"), f["detail"].alias("detail"))


def flag_manifest(rows: DataFrame) -> DataFrame:
    """doc_id, file_name, json: the flags of each document, pages in order; an empty list if it has none."""
    stem = labels(rows)[1]
    each = rows.select("doc_id", stem.alias("stem"), "page_no", F.explode_outer("ocr_flags").alias("f"))
    listed = each.groupBy("doc_id", "stem").agg(F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("page_no", F.col("f.region").alias("region"), _flag(F.col("f"), F.col("page_no")).alias("flag"))))).alias("l"))
    return listed.select("doc_id", F.concat("stem", F.lit("_recovery_flags.json")).alias("file_name"), F.to_json(F.transform("l", lambda x: x["flag"])).alias("json"))


def table_report(rows: DataFrame) -> DataFrame:
    """doc_id, file_name, json: of each page its status, flags and number of native tables."""
    source, stem = labels(rows)
    some = (F.col("n_tables") > 0) | F.col("ocr_flags").isNotNull()
    flags = F.transform("ocr_flags", lambda f: _flag(f, F.col("page_no")))
    page = F.struct(F.col("page_no").alias("source_page"), F.when(some, "Native tables and image recovery in page order.").otherwise("No ruled table detected; review digital/borderless content.").alias("status"), F.coalesce(flags, F.array()).alias("ocr_flags"), F.col("n_tables").alias("native_table_count"))
    docs = rows.groupBy("doc_id", source.alias("source"), stem.alias("stem")).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return docs.select("doc_id", F.concat("stem", F.lit("_table_report.json")).alias("file_name"), F.to_json(F.struct("source", F.size("pages").alias("completed_pages"), "pages")).alias("json"))


def warnings(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, warning: what validation finds in page records, and in documents without any."""
    return S.validation(rows, issues="warnings", page="page_no", versioned=True, documents=docs)


def artefacts(rows: DataFrame, results: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """file_name, data: of each recognized region its text, the recognizer's own result and, if there is one, its image."""
    stem = labels(rows)[1]
    named = rows.select(*layout.PAGE, stem.alias("stem"))
    folder = F.concat("stem", F.format_string("_ocr/page-%d-region-%d/", "page_no", "region"))
    both = results.join(named, list(layout.PAGE)).withColumn("_f", folder)
    texts = both.select(F.explode(F.array(F.struct(F.concat("_f", F.lit("content.md")).alias("file_name"), F.encode(F.coalesce("markdown", F.lit("")), "UTF-8").alias("data")), F.struct(F.concat("_f", F.lit("ocr_result.json")).alias("file_name"), F.encode(F.coalesce("raw", F.lit("{}")), "UTF-8").alias("data")))).alias("x")).select("x.*")
    if images is None:
        return texts
    drawn = images.where("image is not null").join(named, list(layout.PAGE)).select(F.concat(folder, F.lit("region.png")).alias("file_name"), F.col("image").alias("data"))
    return texts.unionByName(drawn)


def convert(
    spark: SparkSession, paths: list[str], folder: str, fmt: str = "json", pages: str = "", engine: str = "native", make_backend=None, name: str = "", store: str | None = None,
    doc_type: str = "auto", workers: int | None = None, work: str | None = None, decoder: Callable = pdf.decode, make_renderer=None, say: Callable[[str], None] = lambda _: None,
) -> tuple[list[str], list[tuple[str, str]]]:
    """Paths written and (document, error) of what couldn't be read. engine ``ocr`` needs a recognizer and a store.

    Beside the documents a manifest of the flags is written, before recognition and after it, what validation warns of, and
    for tables a report of the pages. ``work`` is the folder of what is kept for other runs, by default one in ``folder``.
    A document without all of the pages asked for is a failure; raises if none is left, or if a table format finds no table."""
    for value, domain, what in ((engine, ENGINES, "engine"), (doc_type, DOC_TYPES, "doc_type"), (fmt, FORMATS, "format"), (workers, (None, *WORKERS), "workers")):
        if value not in domain:
            raise ValueError(f"{what} must be one of {domain}")
    if engine == "ocr" and (make_backend is None or store is None):
        raise ValueError("recognition needs a backend and a store")
    ship(spark)
    wanted = [n + 1 for n in pdf.parse_pages(pages)] if pages.strip() else []
    work = f"{(work or folder + '/_work').rstrip('/')}/{FORM}"
    files, none = pdf.files(spark, paths)
    failed = [(p, "FileNotFoundError: nothing matches") for p in none]
    docs = documents(files).persist()  # short rows, read with every table below
    objects = decoded(files, Kept(spark, f"{work}/objects"), decoder)
    bad = objects.where("kind = 'error'").join(docs, "digest").select("source", "text")
    failed += [tuple(r) for r in bad.collect()]
    native = native_pages(objects, files, Kept(spark, f"{work}/pages"))
    rows = native.dropDuplicates(["digest", "page_no"]).join(docs, "digest")
    if wanted:
        rows = rows.where(F.col("page_no").isin(wanted)).withColumn("_n", F.count("*").over(Window.partitionBy("doc_id")))
        good = objects.where("kind <> 'error'").select("digest").distinct().join(docs, "digest")
        short = good.join(rows.where(F.col("_n") == len(wanted)).select("doc_id").distinct(), "doc_id", "left_anti")
        failed += [(r[0], f"ValueError: {OUT_OF_RANGE}") for r in short.select("source").collect()]
        rows = rows.where(F.col("_n") == len(wanted)).drop("_n")
        if rows.isEmpty():
            raise ValueError(OUT_OF_RANGE)
    say(f"Native pass: {rows.count()} pages")
    results = None
    if engine == "ocr":
        sinks.write_files(flag_manifest(recovered(rows)), folder, "file_name", "json").collect()
        kept = recovery.Store(spark, store, docs.select("doc_id", "digest"), POLICY)
        schema = recovery.RESULTS.replace("bigint", "string")
        flags = recovery.flags(rows)
        todo = recovery.pending(flags, kept.read(schema), whole_pages=True)
        drawn = None
        if make_renderer is not None:
            sized = todo.join(rows.select(*layout.PAGE, F.get("page_size", 0).alias("width"), F.get("page_size", 1).alias("height"), F.col("orientation_correction").alias("turn")), list(layout.PAGE))
            drawn = recovery.rendered_regions(sized, files.withColumnRenamed("path", "doc_id"), make_renderer)
            todo = drawn
        kept.add(recovery.recognize(todo.repartition(workers) if workers else todo, make_backend))
        results = kept.read(schema)
        results = results.groupBy(*recovery.REGION).agg(F.max_by(F.struct("markdown", "raw", "status"), F.struct(recovery.finished(F.col("markdown")), "attempt")).alias("x")).select(*recovery.REGION, "x.*")
        sinks.write_files(artefacts(rows, results.join(flags, list(recovery.REGION), "left_semi"), drawn), folder, "file_name", "data", bytes).collect()
        say("Recognition done; recognized text is never called accurate")
    done = recovered(rows, results)
    sinks.write_files(flag_manifest(done), folder, "file_name", "json").collect()
    found = warnings(done, docs).join(docs.select("doc_id", "stem"), "doc_id").groupBy("stem").agg(F.array_sort(F.collect_list("warning")).alias("w"))
    sinks.write_files(found.select(F.concat("stem", F.lit("_validation.json")).alias("f"), F.to_json("w").alias("j")), folder, "f", "j").collect()
    reports = [r[0] for r in sinks.write_files(table_report(done), folder, "file_name", "json").collect()] if fmt in ("csv", "xlsx") else []
    paths_out = [r[0] for r in write(done, folder, fmt, name, doc_type).collect()]
    docs.unpersist()
    if fmt in ("csv", "xlsx") and not paths_out:
        raise ValueError("no tables exported; see the table report")
    for p in sorted(paths_out):
        say(f"Output written: {p}")
    return sorted(paths_out) + sorted(reports), failed


def _named(spec: str):
    """module:attribute as the object."""
    module, _, attribute = spec.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("files", nargs="*")
    p.add_argument("--out", default="output")
    p.add_argument("--format", choices=FORMATS, default="json")
    p.add_argument("--pages", default="")
    p.add_argument("--name", default="")
    p.add_argument("--engine", choices=ENGINES, default="native")
    p.add_argument("--doc-type", choices=DOC_TYPES, default="auto")
    p.add_argument("--workers", type=int, choices=WORKERS)
    p.add_argument("--backend", help="module:factory of a recognizer")
    p.add_argument("--renderer", help="module:factory of a rasterizer")
    p.add_argument("--store")
    p.add_argument("--work")
    p.add_argument("--log", help="a file that every line is added to")
    p.add_argument("--request", help="a JSON file with these options")
    a = p.parse_args(argv)
    from quire.session import session

    spark = session("quire-convert")
    options = {k: v for k, v in vars(a).items() if k != "request"}
    if a.request:
        options |= jobs.request(spark, a.request)
    if not options["files"]:
        p.error("no files")
    say = jobs.Log(options["log"]).add if options["log"] else print
    done, failed = convert(
        spark, options["files"], options["out"], options["format"], options["pages"], options["engine"], _named(options["backend"]) if options["backend"] else None, options["name"], options["store"],
        options["doc_type"], options["workers"], options["work"], make_renderer=_named(options["renderer"]) if options["renderer"] else None, say=say,
    )
    for doc, error in failed:
        say(f"{doc}: {error}")
        print(f"{doc}: {error}", file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
