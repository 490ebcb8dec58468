"""Queries on recognition and output: flags, results, blocks, documents, HTML tables; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import html_tables, layout, recovery, render
from quire.operators.recovery import REGION
from quire.plans.prose import strip
from quire.sources.tables import table


def sections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sections").dropDuplicates(["section_key"])


def results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_results")


def given_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The flags that sections hold: doc_id, page_no, region, flag_id, bbox, status."""
    rows = sections(spark, folder).select("doc_id", F.col("source_page").alias("page_no"), F.posexplode("ocr_flags").alias("_i", "f")).where("f is not null")
    return rows.select("doc_id", "page_no", (F.col("_i") + 1).cast("int").alias("region"), F.col("f.id").alias("flag_id"), F.col("f.bbox").alias("bbox"), F.col("f.status").alias("status"))


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sections(spark, folder).select("doc_id", F.col("source_page").alias("page_no"), "raw_text", "image_regions", "page_size", F.size(F.coalesce("native_tables", F.array())).alias("n_tables"))


def merged_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Image regions of each section, those that touch as one."""
    rows = sections(spark, folder).where(F.size("image_regions") > 0).select("section_key", recovery.merge_regions("image_regions").alias("r"))
    return rows.select("section_key", F.posexplode_outer("r").alias("n", "b")).select("section_key", "n", *(F.get("b", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def recovery_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags of all pages, made anew: merged regions, or the page where it can't be read."""
    return recovery.flags(page_rows(spark, folder)).select("doc_id", "page_no", "region", "flag_id", "status", "reason", "image_sequence")


def image_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of flagged pages."""
    pages = given_flags(spark, folder).select("doc_id", "page_no").distinct()
    return recovery.sequences(pages)


def flag_result_left_join(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each flag by the last attempt at its region."""
    out = recovery.resolved(given_flags(spark, folder), recovery.last_results(results(spark, folder)))
    return out.select(*REGION, "flag_id", "status", "detail", "text")


def flag_first_result(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the first attempt."""
    out = recovery.resolved(given_flags(spark, folder), recovery.first_results(results(spark, folder)))
    return out.select(*REGION, "flag_id", "status")


def flag_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Flags, flagged pages and unresolved flags of each document."""
    out = recovery.resolved(given_flags(spark, folder), recovery.last_results(results(spark, folder)))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_flags"), F.count_distinct("page_no").alias("n_pages"), F.count_if(F.col("status") != "converted").alias("n_open"))


def pending_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Flags that no attempt has finished."""
    return recovery.pending(given_flags(spark, folder), results(spark, folder)).select(*REGION, "flag_id")


def pending_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of sections without a record delivered."""
    pages = sections(spark, folder).select("doc_id", F.col("source_page").alias("page_no"))
    stored = table(spark, folder, "raw_records").select("doc_id", F.col("source_page").alias("page_no"))
    return pages.join(stored, ["doc_id", "page_no"], "left_anti").distinct()


def stored_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of sections with one."""
    pages = sections(spark, folder).select("doc_id", F.col("source_page").alias("page_no"))
    stored = table(spark, folder, "raw_records").select("doc_id", F.col("source_page").alias("page_no"))
    return pages.join(stored, ["doc_id", "page_no"], "left_semi").distinct()


def quality_warnings(spark: SparkSession, folder: str) -> DataFrame:
    rows = results(spark, folder).select(*REGION, "attempt", F.explode_outer(X.quality_warnings(F.col("raw"), F.col("markdown"))).alias("warning")).where("warning is not null")
    return rows.distinct()


def _native(spark: SparkSession, folder: str) -> DataFrame:
    rows = sections(spark, folder).select("doc_id", F.col("source_page").alias("page_no"), F.posexplode("source_lines").alias("ordinal", "l")).where("l is not null")
    return rows.select("doc_id", "page_no", "ordinal", F.col("l.bbox").alias("bbox"), F.coalesce("l.text", F.lit("")).alias("text"))


def ordered_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Native lines and what stands for images, of flagged pages."""
    out = recovery.resolved(given_flags(spark, folder), recovery.last_results(results(spark, folder)))
    return recovery.blocks(_native(spark, folder), out)


def rendered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The content of flagged pages, in order."""
    return recovery.rendered(ordered_blocks(spark, folder)).select("doc_id", "page_no", "content")


def warnings_after_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """Warnings of flagged pages with those of their images; the note on untranscribed images goes once all are converted."""
    out = recovery.resolved(given_flags(spark, folder), recovery.last_results(results(spark, folder)))
    per = out.groupBy("doc_id", "page_no").agg(F.min(F.col("status") == "converted").alias("all"), F.array_sort(F.collect_list(F.struct("region", "quality_warnings"))).alias("q"))
    noted = F.flatten(F.transform("q", lambda x: F.transform(F.coalesce(x["quality_warnings"], F.array().cast("array<string>")), lambda w: F.format_string("Image %d: %s", x["region"], w))))
    pages = sections(spark, folder).select("doc_id", F.col("source_page").alias("page_no"), F.coalesce("warnings", F.array().cast("array<string>")).alias("w"))
    rows = pages.join(per, ["doc_id", "page_no"]).select("doc_id", "page_no", F.explode_outer(recovery.page_warnings(F.col("w"), noted, F.col("all"))).alias("warning"))
    return rows.where("warning is not null").distinct()


def review_required(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a document with sections needs a look: any warning, or any flag that isn't converted."""
    s = sections(spark, folder)
    odd = (F.size(F.coalesce("warnings", F.array())) > 0) | F.exists(F.coalesce("ocr_flags", F.array()), lambda f: F.coalesce(f["status"] != "converted", F.lit(False)))
    return s.groupBy("doc_id").agg(F.max(F.coalesce(odd, F.lit(False))).alias("review_required"), F.count("*").alias("n_sections"))


def digest_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of each document's text, and a short key of digest, policy and turn."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.select("doc_id", "digest", F.substring(F.sha2(F.concat_ws("|", "digest", F.lit("inline-v2"), F.lit("0")), 256), 1, 24).alias("key"))


def fence_length(spark: SparkSession, folder: str) -> DataFrame:
    """The fence that each section's content needs."""
    return sections(spark, folder).where("content is not null").select("section_key", X.fence(F.col("content")).alias("fence"))


def document_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with sections as Markdown, page after page."""
    s = sections(spark, folder).withColumn("seq", F.struct("source_page", "section_key"))
    text = render.section_markdown(F.coalesce("id", F.lit("")), F.coalesce("title", F.lit("")), F.col("warnings"), F.coalesce("layout_text", "content"), F.col("ocr_markdown"))
    pages = s.select("doc_id", "seq", text.alias("section_markdown"))
    titles = table(spark, folder, "documents").select("doc_id", "title")
    return render.documents_markdown(pages.join(titles, "doc_id", "left"))


def whole_page_recognition(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the recognized text that sections hold of them: which text stands, what is noted."""
    s = sections(spark, folder)
    pages = s.select("doc_id", F.col("source_page").alias("page_no"), F.coalesce("raw_text", F.lit("")).alias("content"), "warnings")
    found = s.where("ocr_markdown is not null").select("doc_id", F.col("source_page").alias("page_no"), F.col("ocr_markdown").alias("markdown"))
    out = recovery.whole_pages(pages, found)
    return out.select("doc_id", "page_no", "content", "native_content", F.size(F.coalesce("warnings", F.array())).alias("n_warnings"))


def document_text(spark: SparkSession, folder: str) -> DataFrame:
    """The raw text of each document with sections, page after page."""
    s = sections(spark, folder).where("raw_text is not null")
    pages = F.array_sort(F.collect_list(F.struct("source_page", "section_key", "raw_text")))
    return s.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda x: x["raw_text"]), "\n").alias("text"))


def readable_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Recognized text with its tables as pipe tables."""
    last = recovery.last_results(results(spark, folder)).where("markdown is not null")
    return last.select(*REGION, html_tables.readable_markdown("markdown").alias("markdown"))


def result_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the HTML tables in recognized text."""
    return html_tables.cells(recovery.last_results(results(spark, folder)), F.col("markdown"), REGION)


def html_grid(spark: SparkSession, folder: str) -> DataFrame:
    """An HTML table a region, written from nations and read again."""
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), F.col("n_name"), F.lit("</td></tr>"))
    nation = table(spark, folder, "nation").withColumn("r", F.struct("n_nationkey", row.alias("row")))
    pages = nation.groupBy("n_regionkey").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))
    return html_tables.cells(pages, F.col("html"), ("n_regionkey",))


def block_row_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Native tables and recognized regions of each page stacked to one grid: where each block's rows begin."""
    s = sections(spark, folder).select("doc_id", F.col("source_page").alias("page_no"), "section_key", F.posexplode("native_tables").alias("i", "t")).where("t is not null")
    native = s.select("doc_id", "page_no", F.lit("native").alias("kind"), F.col("i").alias("n"), F.size("t.rows").alias("n_rows"), F.get("t.bbox", 3).alias("top"), F.get("t.bbox", 0).alias("left"))
    flags = recovery.resolved(given_flags(spark, folder), recovery.last_results(results(spark, folder)))
    ocr = flags.select("doc_id", "page_no", F.lit("ocr").alias("kind"), F.col("region").alias("n"), F.lit(1).alias("n_rows"), F.get("bbox", 3).alias("top"), F.get("bbox", 0).alias("left"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("top"), "left", "kind", "n").rowsBetween(Window.unboundedPreceding, -1)
    return native.unionByName(ocr).withColumn("first_row", F.coalesce(F.sum("n_rows").over(w), F.lit(0)).cast("bigint"))


def page_table_files(spark: SparkSession, folder: str) -> DataFrame:
    """The one grid of each page as it goes to a file: native tables and recognized regions, from the top left, and the file's name."""
    s = sections(spark, folder).select("doc_id", F.col("source_page").alias("page_no"), F.posexplode("native_tables").alias("i", "t")).where("t is not null")
    native = s.select("doc_id", "page_no", F.struct((-F.get("t.bbox", 3)).alias("top"), F.get("t.bbox", 0).alias("left"), F.lit(0).alias("k"), F.col("i").alias("n"), F.col("t.rows").alias("rows")).alias("b"))
    done = recovery.resolved(given_flags(spark, folder), recovery.last_results(results(spark, folder)))
    text = F.when(F.col("status") == "converted", html_tables.stacked("text")["rows"]).otherwise(F.array(F.array("text")))
    ocr = done.select("doc_id", "page_no", F.struct((-F.get("bbox", 3)).alias("top"), F.get("bbox", 0).alias("left"), F.lit(1).alias("k"), F.col("region").alias("n"), text.alias("rows")).alias("b"))
    pages = native.unionByName(ocr).groupBy("doc_id", "page_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list("b")), lambda x: F.coalesce(x["rows"], F.array()))).alias("rows"))
    name = F.format_string("%d_tables_page-%d-table-1.csv", "doc_id", "page_no")
    return pages.where(F.size("rows") > 0).select("doc_id", "page_no", name.alias("file_name"), F.size("rows").alias("n_rows"), F.to_json("rows").alias("rows_json"))


def table_report(spark: SparkSession, folder: str) -> DataFrame:
    """What a table export says of each page: its native tables, flags and status."""
    s = sections(spark, folder)
    n_tables, n_flags = F.size(F.coalesce("native_tables", F.array())), F.size(F.coalesce("ocr_flags", F.array()))
    status = F.when((n_tables > 0) | (n_flags > 0), "Native tables and image recovery in page order.").otherwise("No ruled table detected; review digital/borderless content.")
    return s.select("section_key", "source_page", n_tables.alias("native_table_count"), n_flags.alias("n_flags"), status.alias("status"))


def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts by outcome."""
    r = results(spark, folder).dropDuplicates([*REGION, "attempt"])
    return r.groupBy((F.col("status") == "OCR completed; review accuracy.").alias("completed")).agg(F.count("*").alias("n"))


def attempt_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean text length and seconds to delivery of attempts, by document."""
    r = results(spark, folder).dropDuplicates([*REGION, "attempt"])
    secs = F.expr("timestampdiff(MICROSECOND, finished_at, received_at)") / 1e6
    return r.groupBy("doc_id").agg(F.round(F.avg(F.length("markdown")), 6).alias("mean_chars"), F.round(F.avg(secs), 4).alias("mean_seconds"), F.count("*").alias("n"))


def worker_capacity(spark: SparkSession, folder: str) -> DataFrame:
    """Largest peak of a document's attempts (a thousandth of the characters as GiB), and the workers that 16 GiB hold."""
    r = results(spark, folder).groupBy("doc_id").agg(F.max(F.coalesce(F.length("markdown"), F.lit(0)) / 1000.0).alias("peak"))
    budget = layout.worker_budget(F.col("peak"))
    return r.select("doc_id", budget.alias("budget"), layout.capacity(F.lit(16.0), budget).alias("workers"))


_QUERIES = (merged_regions, recovery_flags, image_sequences, flag_result_left_join, flag_first_result, flag_totals, pending_regions, pending_pages, stored_pages, quality_warnings, ordered_blocks, rendered_pages, warnings_after_recovery, review_required, digest_keys, fence_length, document_markdown, whole_page_recognition, document_text, readable_markdown, result_tables, html_grid, block_row_offsets, page_table_files, table_report, outcome_counts, attempt_stats, worker_capacity)
QUERIES = {q.__name__: q for q in _QUERIES}

_S = "with s as (select distinct on (section_key) * from sections order by section_key),\n"
_MD = strip("coalesce(markdown, '')")


def _base(pick: str) -> str:
    return (
        _S
        + f"""f0 as (select doc_id, source_page page_no, unnest(range(1, len(ocr_flags) + 1)) i, unnest(ocr_flags) f from s), f as (select doc_id, page_no, cast(i as int) region, f.id flag_id, f.bbox bbox from f0 where f is not null),
x as (select doc_id, page_no, region, {pick}({{'markdown': markdown, 'raw': raw, 'st': status}}, (attempt, finished_at, received_at, coalesce(markdown, ''))) v from ocr_results group by 1, 2, 3),
x1 as (select doc_id, page_no, region, v.markdown markdown, v.raw raw, v.st st from x),
r0 as (select f.*, markdown, raw, st, x1.doc_id is not null there, {_MD} <> '' done from f left join x1 on f.doc_id = x1.doc_id and f.page_no = x1.page_no and f.region = x1.region),
r1 as (select *, case when done then 'converted' when there then 'unresolved' else 'pending' end status from r0),
r as (select *, case when status = 'unresolved' then coalesce(st, 'No readable OCR content') end detail, case when done then markdown else '[OCR ' || upper(status) || ': ' || flag_id || ' — image content requires review]' end as text from r1)
"""
    )


_R = _base("arg_max")
_Q = """[case when contains(lower(coalesce(markdown, '')), '<table') then 'Verify table identifiers, units, superscripts and merged cells against the source.' end,
  case when len(list_filter(coalesce(scores, []), lambda v: v < 0.9)) > 0 then 'Some recognized lines have confidence below 0.90; compare with source.' end,
  case when regexp_matches(coalesce(markdown, ''), '[A-Za-z]{28,}') then 'Unusually long joined words suggest missing spaces or recognition errors.' end,
  case when len(regexp_extract_all(coalesce(markdown, ''), '\\$')) % 2 = 1 or contains(coalesce(markdown, ''), '^{$') then 'Malformed mathematical notation; verify symbols and superscripts.' end]"""
_SCORES = "case when json_valid(raw) then cast(coalesce(case when json_type(raw::json->'$.res') is not null then raw::json->'$.res' end, raw::json)->'$.overall_ocr_res.rec_scores' as double[]) end scores"
_BLOCKS = (
    _R
    + """, l as (select doc_id, source_page page_no, unnest(range(len(source_lines))) i, unnest(source_lines) l from s),
b as (select doc_id, page_no, 'native' kind, cast(i as int) ordinal, coalesce(l.bbox[1], 0) x0, coalesce(l.bbox[4], 0) top, coalesce(l.text, '') as text, null::varchar flag_id from l where l is not null and (doc_id, page_no) in (select (doc_id, page_no) from f)
 union all select doc_id, page_no, 'ocr', 1000000 + region, coalesce(bbox[1], 0), coalesce(bbox[4], 0), text, flag_id from r)
"""
)
SQL = {
    "image_sequences": _R + ", p as (select distinct doc_id, page_no from f), n as (select *, case when page_no - lag(page_no) over w > 1 or lag(page_no) over w is null then 1 else 0 end fresh from p window w as (partition by doc_id order by page_no)) select doc_id, page_no, cast(sum(fresh) over (partition by doc_id order by page_no) as int) image_sequence from n",
    "flag_result_left_join": _R + "select doc_id, page_no, region, flag_id, status, detail, text from r",
    "flag_first_result": _base("arg_min") + "select doc_id, page_no, region, flag_id, status from r",
    "flag_totals": _R + "select doc_id, count(*) n_flags, count(distinct page_no) n_pages, count(*) filter (status <> 'converted') n_open from r group by 1",
    "pending_regions": _R + f"select doc_id, page_no, region, flag_id from f where (doc_id, page_no, region) not in (select (doc_id, page_no, region) from ocr_results where {_MD} <> '')",
    "pending_pages": "select distinct doc_id, source_page page_no from sections s where not exists (select 1 from raw_records r where r.doc_id = s.doc_id and r.source_page = s.source_page)",
    "stored_pages": "select distinct doc_id, source_page page_no from sections s where exists (select 1 from raw_records r where r.doc_id = s.doc_id and r.source_page = s.source_page)",
    "quality_warnings": f"with a as (select *, {_SCORES} from ocr_results), w as (select distinct doc_id, page_no, region, attempt, unnest({_Q}) warning from a) select * from w where warning is not null",
    "ordered_blocks": _BLOCKS + "select * from b",
    "rendered_pages": _BLOCKS + "select doc_id, page_no, string_agg(text, chr(10) || chr(10) order by top desc, x0, ordinal) as content from b group by 1, 2",
    "warnings_after_recovery": _R
    + f""", q as (select doc_id, page_no, region, unnest({_Q}) w from (select *, {_SCORES} from r where done)), p as (select doc_id, page_no, bool_and(status = 'converted') done from r group by 1, 2),
n as (select s.doc_id, s.source_page page_no, unnest(warnings) w, p.done from s join p on s.doc_id = p.doc_id and s.source_page = p.page_no)
select doc_id, page_no, w warning from n where not (done and starts_with(w, 'Embedded images are not transcribed')) union select doc_id, page_no, 'Image ' || region || ': ' || w from q where w is not null""",
    "review_required": _S + "_ as (select 1) select doc_id, bool_or(coalesce(len(warnings), 0) > 0 or len(list_filter(coalesce(ocr_flags, []), lambda f: f.status <> 'converted')) > 0) review_required, count(*) n_sections from s group by 1",
    "digest_keys": "select doc_id, sha256(text) digest, substr(sha256(sha256(text) || '|inline-v2|0'), 1, 24) as key from documents where text is not null",
    "fence_length": _S + "_ as (select 1) select section_key, repeat('`', cast(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda m: length(m))), 0) + 1) as int)) fence from s where content is not null",
    "html_grid": "with r as (select n_regionkey, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) i from nation) select n_regionkey, 1 table_no, cast(i as int) r, 1 c, cast(n_nationkey as varchar) as value from r union all select n_regionkey, 1, cast(i as int), 2, n_name from r",
    "block_row_offsets": _R
    + ", t0 as (select doc_id, source_page page_no, unnest(range(len(native_tables))) i, unnest(native_tables) t from s), b as (select doc_id, page_no, 'native' kind, cast(i as int) n, cast(len(t.rows) as int) n_rows, t.bbox[4] top, t.bbox[1] as left from t0 where t is not null union all select doc_id, page_no, 'ocr', region, 1, bbox[4], bbox[1] from r) select *, cast(coalesce(sum(n_rows) over (partition by doc_id, page_no order by top desc, \"left\", kind, n rows between unbounded preceding and 1 preceding), 0) as bigint) first_row from b",
    "whole_page_recognition": _S
    + f"""_ as (select 1) select doc_id, source_page page_no, case when coalesce(ocr_markdown, '') <> '' then ocr_markdown else coalesce(raw_text, '') end content, case when ocr_markdown is not null then coalesce(raw_text, '') end native_content,
cast(coalesce(len(warnings), 0) + case when ocr_markdown is null then 0 when {strip('ocr_markdown')} = '' then 2 else 1 end as int) n_warnings from s""",
    "document_text": _S + "_ as (select 1) select doc_id, string_agg(raw_text, chr(10) order by source_page, section_key) as text from s where raw_text is not null group by 1",
    "table_report": _S + "_ as (select 1) select section_key, source_page, cast(coalesce(len(native_tables), 0) as int) native_table_count, cast(coalesce(len(ocr_flags), 0) as int) n_flags, case when coalesce(len(native_tables), 0) > 0 or coalesce(len(ocr_flags), 0) > 0 then 'Native tables and image recovery in page order.' else 'No ruled table detected; review digital/borderless content.' end status from s",
    "outcome_counts": "select status = 'OCR completed; review accuracy.' completed, count(*) n from (select distinct doc_id, page_no, region, attempt, status from ocr_results) group by 1",
    "attempt_stats": "select doc_id, round(avg(length(markdown)), 6) mean_chars, round(avg(epoch_us(received_at) - epoch_us(finished_at)) / 1e6, 4) mean_seconds, count(*) n from (select distinct on (doc_id, page_no, region, attempt) * from ocr_results order by doc_id, page_no, region, attempt) group by 1",
    "worker_capacity": "with p as (select doc_id, max(coalesce(length(markdown), 0) / 1000.0::double) peak from ocr_results group by 1), b as (select doc_id, greatest(2.5::double, peak * 1.25::double) budget from p) select doc_id, budget, cast(greatest(0, least(3, floor(13.0 / budget))) as int) workers from b",
    "document_markdown": _S
    + r"""m as (select doc_id, source_page, section_key, '## ' || coalesce(id, '') || ' ' || coalesce(title, '') || chr(10) || chr(10) || coalesce((select string_agg('> Extraction review: ' || w || chr(10) || chr(10), '' order by k) from (select unnest(warnings) w, unnest(range(len(warnings))) k)), '') h, coalesce(ocr_markdown, '') o, coalesce(layout_text, content, '') t from s),
f as (select *, repeat('`', cast(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda m: length(m))), 0) + 1) as int)) f from m),
p as (select doc_id, source_page, section_key, h || case when o <> '' then o || chr(10) || chr(10) || '### Native PDF text for comparison' || chr(10) || chr(10) else '' end || f || 'text' || chr(10) || t || chr(10) || f x from f)
select p.doc_id, """
    + strip("'# ' || coalesce(any_value(d.title), 'Unknown') || chr(10) || chr(10) || string_agg(x, chr(10) || chr(10) order by source_page, section_key)")
    + " || chr(10) markdown from p left join documents d on p.doc_id = d.doc_id group by 1",
}
