"""Column functions on text: normal forms, line predicates, names. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, in a form that Java and RE2 both read.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Line ends of str.splitlines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Words that a title may write small; symbols of drawings; words of image stubs.
MINOR_WORDS = "a an the to of in on at for by and or nor but with as from into over under about above below between through during".split()
PAGE_NUMBER = rf"(?i)^{WS}*(?:\d{{1,3}}-\d{{1,3}}|Page{WS}+\d+|\d{{1,4}}){WS}*$"
FIGURE_CAPTION = rf"(?i)^{WS}*Figure{WS}+[\p{{L}}\p{{N}}_\-]+[.:]"
IMAGE_CAPTION = rf"(?i)^{WS}*(?:Image|Photo|Illustration|Diagram){WS}+[\p{{L}}\p{{N}}_\-]+[.:]"
IMAGE_WORD = rf"(?i)^{WS}*(?:image|photo|illustration|diagram|graphic){WS}*$"
DRAWING = r"^[\s_\-=.|/\\<>\[\]()~`\x{2022}\x{b7}:]{4,}$"
SYMBOLS = r"[_|\-=./\\<>\[\]()~`\x{2022}\x{b7}:]"
CID = r"\(cid:\d+\)"
CHAPTER = rf"(?i)^Chapter{WS}+\d+"
BULLET = rf"^(?:[-*\x{{2022}}]|\d+[.)]|[A-Za-z][.)]){WS}+"
CELL_GAP = r"\t+| {2,}"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(c, rf"{WS}+", " ")


def clean(c: Column) -> Column:
    """Line ends unified, form feeds as blank lines, at most one blank line in a row, ends stripped; nothing else goes."""
    unified = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\f"), F.lit("\n\n"))
    return strip(F.regexp_replace(unified, r"\n{3,}", "\n\n"))


def splitlines(c: Column) -> Column:
    """The lines of a text; none of an empty one, and no empty line after the last line end."""
    parts = F.split(c, LINE_END, -1)
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_bullet(line: Column) -> Column:
    return strip(line).rlike(BULLET)


def cells(line: Column) -> Column:
    """The non-blank cells between tabs or runs of blanks."""
    return F.filter(F.transform(F.split(strip(line), CELL_GAP, -1), strip), lambda x: x != "")


def is_table_row(line: Column) -> Column:
    return (strip(line) != "") & ~is_bullet(line) & (F.size(cells(line)) >= 2)


def is_image_artifact(line: Column) -> Column:
    s = strip(line)
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    symbols = F.regexp_count(s, F.lit(SYMBOLS))
    return (s != "") & (s.rlike(IMAGE_WORD) | s.rlike(DRAWING) | ((letters <= 2) & (symbols >= F.greatest(F.lit(4), F.floor(F.length(s) / 2)))))


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def is_chapter_line(line: Column) -> Column:
    return line.rlike(CHAPTER)


def is_figure_caption(line: Column) -> Column:
    return line.rlike(FIGURE_CAPTION)


def is_title_case(line: Column) -> Column:
    """The first word begins with a capital, later ones too, but for small words and what begins without a letter."""
    words = F.filter(F.split(line, rf"{WS}+", -1), lambda w: w != "")
    bare = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.regexp_replace(w, "^['\"]+|['\"]+$", ""))
    fits = F.forall(bare, lambda w: ~w.rlike(r"^\p{L}") | F.lower(w).isin(MINOR_WORDS) | w.rlike(r"^[\p{Lu}\p{Lt}]"))
    return F.get(words, 0).rlike(r"^[\p{Lu}\p{Lt}]").eqNullSafe(True) & fits


def is_all_caps(line: Column) -> Column:
    return (line == F.upper(line)) & line.rlike(r"\p{L}")


def is_heading(line: Column) -> Column:
    """What may head a section, by itself: 3 to 120 characters, no point or colon, title case or capitals."""
    s = strip(line)
    shape = s.rlike(r"^[\p{L}\p{N}]") & F.length(s).between(3, 120) & ~s.contains(".") & ~s.contains(":")
    return shape & ~is_figure_caption(s) & ~is_page_number(s) & (is_title_case(s) | is_all_caps(s))


def stem(path: Column) -> Column:
    """The file's name without folder and last suffix."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def chapter_number(path: Column) -> Column:
    """The chapter that a file's name tells, else 0."""
    s = stem(path)
    told = F.regexp_extract(s, r"(?i)(?:^|[ _-])(?:chapter|ch)[ _-]*(\d+)(?:\D|$)", 1)
    whole = F.regexp_extract(s, r"^(\d{1,3})$", 1)
    return F.coalesce(F.nullif(told, F.lit("")).try_cast("int"), F.nullif(whole, F.lit("")).try_cast("int"), F.lit(0))


def output_base(name: Column, source: Column) -> Column:
    """The base of output names: a given name without one known suffix, else by chapter, else by stem."""
    given = F.regexp_replace(strip(name), r"(?i)\.(json|md|csv|xlsx)$", "")
    n = chapter_number(source)
    return F.coalesce(F.nullif(given, F.lit("")), F.when(n > 0, F.concat(F.lit("chapter_"), n.cast("string"), F.lit("_rag"))), F.concat(stem(source), F.lit("_rag")))


def fence(text: Column) -> Column:
    """A code fence longer than any run of backticks within."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def placeholder(status: Column, flag_id: Column) -> Column:
    return F.concat(F.lit("[OCR "), F.upper(status), F.lit(": "), flag_id, F.lit(" — image content requires review]"))


def quality_warnings(raw: Column, markdown: Column) -> Column:
    """What of a recognition result calls for a look: tables, low scores, joined words, broken formulas."""
    v = F.try_parse_json(raw)
    scores = F.coalesce(F.try_variant_get(v, "$.res.overall_ocr_res.rec_scores", "array<double>"), F.when(F.try_variant_get(v, "$.res", "variant").isNull(), F.try_variant_get(v, "$.overall_ocr_res.rec_scores", "array<double>")))
    m = F.coalesce(markdown, F.lit(""))
    return F.array_compact(
        F.array(
            F.when(F.lower(m).contains("<table"), F.lit("Verify table identifiers, units, superscripts and merged cells against the source.")),
            F.when(F.exists(F.coalesce(scores, F.array().cast("array<double>")), lambda s: s < 0.9), F.lit("Some recognized lines have confidence below 0.90; compare with source.")),
            F.when(m.rlike("[A-Za-z]{28,}"), F.lit("Unusually long joined words suggest missing spaces or recognition errors.")),
            F.when((F.regexp_count(m, F.lit(r"\$")) % 2 == 1) | m.contains("^{$"), F.lit("Malformed mathematical notation; verify symbols and superscripts.")),
        )
    )


def page_issues(raw: Column, has_images: Column, has_rules: Column) -> Column:
    """What of a page's native content calls for a look."""
    s = strip(F.coalesce(raw, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(s == "", F.lit("No extractable text: page may be blank, scanned, or contain vector outlines; review/OCR required.")).when(F.length(s) < 40, F.lit("Sparse text: review page for missing content.")),
            F.when(has_images, F.lit("Embedded images are not transcribed; review figures and any text inside images.")),
            F.when(raw.contains("\ufffd") | raw.rlike(CID), F.lit("Unresolved font characters detected; review/OCR required.")),
            F.when(has_rules, F.lit("Rules or vector graphics detected; table relationships and diagrams require review.")),
        )
    )


def page_list(spec: Column) -> Column:
    """'1,3-5,3' to the zero-based pages [0, 2, 3, 4]; null for a blank (all pages). What isn't a list of ascending ranges from 1 fails."""
    parts = F.split(strip(spec), ",", -1)
    bad = F.exists(parts, lambda p: ~strip(p).rlike(r"^\d+(?:\s*-\s*\d+)?$"))
    lo = lambda p: F.regexp_extract(strip(p), r"^(\d+)", 1).try_cast("int")
    hi = lambda p: F.regexp_extract(strip(p), r"(\d+)$", 1).try_cast("int")
    wrong = bad | F.exists(parts, lambda p: F.coalesce((lo(p) < 1) | (hi(p) < lo(p)), F.lit(True)))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(lo(p) - 1, hi(p) - 1)))))
    return F.when(strip(spec) == "", F.lit(None)).when(wrong, F.raise_error(F.lit("pages must be numbers from 1 or ascending ranges, such as 1-5,10"))).otherwise(pages)


def page_list_valid(spec: Column) -> Column:
    """Whether page_list can read it."""
    parts = F.split(strip(spec), ",", -1)
    lo = lambda p: F.regexp_extract(strip(p), r"^(\d+)", 1).try_cast("int")
    hi = lambda p: F.regexp_extract(strip(p), r"(\d+)$", 1).try_cast("int")
    return (strip(spec) == "") | F.forall(parts, lambda p: F.coalesce(strip(p).rlike(r"^\d+(?:\s*-\s*\d+)?$") & (lo(p) >= 1) & (hi(p) >= lo(p)), F.lit(False)))


def cache_key(*parts: Column, length: int = 24) -> Column:
    """A short digest of the parts: equal parts, equal key."""
    return F.substring(F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256), 1, length)
