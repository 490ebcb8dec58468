"""Text of scanned pages to continuous paragraphs of right words.

Method: words of all pages are counted into a corpus frequency lexicon, with their pairs. A
symmetric-delete index over the lexicon gives correction candidates: a rare word and a frequent
one, each without one or two letters (a stretch that recognition takes for another, such as
``rn``, counts as one), meet in one key, so no word is compared with all others. Keys are made
in an alphabet where figures and the letters they are taken for are one. Candidates are ranked
by weighted edit distance: confusion pairs have their weights, any other edit of a letter and a
swap of two cost 1. Where a word has several candidates, the pairs with its neighbours (bigram
context) pick the repair; where edits other than confusion pairs are needed, these must speak
for the repair on both sides, and the edit must lie within the word, as endings differ between
right words. Words without a candidate that part into words of the lexicon, pair by pair known,
have lost their blanks.

Around that: running titles are lines at the head or at the foot of three or more pages of a
document, compared by a skeleton in which confusable letters fall together; page numbers are
lines at head or foot of a page number's form alone; a word cut at a line's end is joined with
the next body line's first word, over the page's end if need be, if the lexicon has it in one
word rather than with its hyphen.

Scale: one pass over the texts gives partial counts, cut words and page edges; one more emits
the occurrences of words that aren't common. Only the common words (a bounded number, a
documented parameter) are sent to the tasks, as a filter of what can't be misread; everything
else is joined by key, so the rest of the lexicon may be of any size. No limit on a line's, a
word's or a candidate list's length.

Defined results: null texts give no rows; repeated sections count once; texts of scripts that
part words otherwise have no misread words; code, tables and formulas are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import charforms, markup
from quire.llm.common import once
from quire.session import checkpoint_dir

# What recognition confuses (read, meant), with the weight of the edit.
PAIRS = {("c", "e"): 0.5, ("5", "s"): 0.3, ("l", "i"): 0.4, ("f", "t"): 0.5, ("0", "o"): 0.3, ("1", "l"): 0.3, ("1", "i"): 0.35, ("cl", "d"): 0.4, ("ii", "u"): 0.4, ("rn", "m"): 0.4, ("b", "h"): 0.5, ("9", "g"): 0.3, ("vv", "w"): 0.4, ("n", "ri"): 0.5, ("d", "cl"): 0.5, ("8", "b"): 0.3, ("m", "rn"): 0.5, ("i", "l"): 0.6, ("li", "h"): 0.5, ("h", "li"): 0.6, ("u", "ii"): 0.6, ("w", "vv"): 0.6, ("e", "c"): 0.7, ("t", "f"): 0.7, ("o", "0"): 0.9, ("h", "b"): 0.7, ("6", "b"): 0.4, ("ri", "n"): 0.7, ("2", "z"): 0.4, ("rri", "m"): 0.5}
#: Words that tasks get as a filter; the most frequent of the lexicon.
COMMON = 1 << 16
#: A candidate is so many times as frequent as the word it would stand for, and so frequent at least.
RATIO, LEAST = 8, 4
#: Letters from which on a word may differ by other edits than confusion pairs, how many times more frequent the other then is, and the letters at its start and end where these don't count (inflection).
GENERAL, GENERAL_RATIO, INNER = 6, 16, (1, 2)
#: How many times better a neighbour must know the repair than the word as it is read.
CONTEXT = 4
#: Largest distance of a candidate, by the least number of letters.
LIMITS = ((12, 2.0), (6, 1.2), (0, 0.8))
#: Letters that are a word.
ALONE = "aàyoeиікв"
#: Pages that make a line a running title.
TITLE_PAGES = 3
EDGE = 2

#: A word has a letter; figures alone are none.
_WORD = re.compile(r"\d*[^\W\d_][^\W_]*(?:['’][^\W_]+)*")
#: Hosts, files, paths and codes, whose parts are no words.
_NAMES = re.compile(r"\S*[@/\\_]\S*")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)+")
_SPACED = re.compile("^[0-9A-Za-zªµºÀ-ɏͰ-ԯḀ-῿'’]+$")
_ROMAN = re.compile(r"^[ivxlcdm]+$")
_CUT = re.compile(r"([^\W\d_]+)[-¬–=‐‑­][ \t]*$")
_MARKS = set("-\u00ac\u2013=\u2010\u2011\u00ad")
_GO_ON = re.compile(r"^[^\w\s]{0,2}([^\W_]+(?:['’][^\W_]+)*)")
_TAGS = re.compile(r"<[^<>\n]*>|&#?\w+;|\\[A-Za-z]+\*?\{[^{}\n]*\}|\]\([^()\n]*\)|\[\[(?:File|Image):[^\]\n]*\]\]|`[^`\n]*`|\$[^$\n]*\$|\{\{[^{}\n]*\}\}")
#: Forms of a page's number alone.
NUMBER = r"^\s*(?:[-–—\[(|]?\s*(?:[Pp]age|[Pp]ag\.?|[Pp]g\.?|[Pp]\.|[Ss]eite|S\.|[Ff]olio|[Ff]ol\.|[Pp]ágina|Стр\.|стр\.|第)?\s*(?:\d{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})(?:\s*(?:/|of|von|de|sur|-|–)\s*\d{1,4})?\s*(?:页|ページ)?\s*[-–—\])|]?)\s*$"
_NUMBER = re.compile(NUMBER)
_AROUND = r"^\W*(?:\d{1,4}|[ivxlc]{1,7})(?=\s{2,}|\s*[|])\W*|\W*(?:\s{2,}|[|]\s*)(?:\d{1,4}|[ivxlc]{1,7})\W*$"


#: A line that goes on with a sentence and ends it, as no title does.
_TAIL = re.compile(r"\s*[^\W\d_A-ZÀ-ÖØ-ÞΑ-ΩА-Я].*[.!?]\s*$")
_ONE_LOOK = str.maketrans("c5lf01bg9862h", "esitoiqqqqqzq")


def skeleton(text: str) -> str:
    """Letters alone, confusable ones as one: equal for a line and what recognition makes of it."""
    t = re.sub(_AROUND, "", text)
    if not t.isascii():
        t = "".join(charforms.LETTERS.get(c, c) for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    t = re.sub(r"[^\w]|_", "", t.lower())
    for a, b in (("rri", "m"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("li", "h")):
        t = t.replace(a, b)
    return re.sub(r"\d", "", t.translate(_ONE_LOOK))


def pages(sections: DataFrame) -> DataFrame:
    """section_key, doc_id, source_page, field, region, text of raw_text, ocr_markdown and image markdown."""
    own = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(0).alias("region"), F.col(c).alias("text")) for c in ("raw_text", "ocr_markdown")))
    images = F.transform(F.coalesce("image_ocr", F.array()), lambda x: F.struct(F.lit("image_markdown").alias("field"), x["region"].alias("region"), x["markdown"].alias("text")))
    narrow = once(sections.select("section_key", "doc_id", "source_page", "raw_text", "ocr_markdown", "image_ocr", "loaded_at"))
    rows = narrow.select("section_key", "doc_id", "source_page", F.inline(F.concat(own, images)))
    return rows.where(F.trim("text") != "")


EDGES = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("number", T.BooleanType())]))
_EDGES_ARROW = pa.list_(pa.struct([("line_no", pa.int32()), ("key", pa.string()), ("number", pa.bool_())]))


@F.arrow_udf(EDGES)
def _edges(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Keys of the outer lines, empty for lines of under four letters and for the ends of sentences begun before."""
    for batch in batches:
        yield pa.array([None if rows is None else [{"line_no": r["line_no"], "key": _line_key(r["line"]), "number": bool(_NUMBER.match(charforms.canonical_line(r["line"])))} for r in rows] for rows in batch.to_pylist()], _EDGES_ARROW)


def _line_key(line: str) -> str:
    t = "" if _TAIL.match(line) else skeleton(line)
    return hashlib.blake2b(t.encode(), digest_size=16).hexdigest() if len(t) >= 4 else ""


def edges(rows: DataFrame) -> DataFrame:
    """The outer lines of each page (of text and whole-page markdown): section, document, page, field, line_no, key, number, rank from the edge, side."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda s: s["line"].rlike(r"\S"))
    few = rows.where("region = 0 and field <> 'image_markdown'").select("section_key", "doc_id", "source_page", "field", lines.alias("l"))
    few = few.withColumn("n", F.size("l")).withColumn("outer", F.when(F.col("n") > 2 * EDGE, F.concat(F.slice("l", 1, EDGE), F.slice("l", -EDGE, EDGE))).otherwise(F.col("l")))
    few = few.withColumn("e", _edges("outer"))
    each = few.select("section_key", "doc_id", "source_page", "field", F.size("e").alias("m"), F.posexplode_outer("e").alias("i", "x")).where(F.col("x").isNotNull())
    return each.select("section_key", "doc_id", "source_page", "field", "x.line_no", "x.key", "x.number", F.col("i").alias("top"), (F.col("m") - 1 - F.col("i")).alias("foot"))


def titles(edge_rows: DataFrame, least_pages: int = TITLE_PAGES) -> DataFrame:
    """doc_id and key of each running title: at one side of so many pages, among the two outermost lines."""
    side = F.explode(F.array_compact(F.array(F.when(F.col("top") <= 1, "head"), F.when(F.col("foot") <= 1, "foot"))))
    near = edge_rows.where((F.col("key") != "") & ~F.col("number")).select("doc_id", "key", "source_page", side.alias("side"))
    counted = near.groupBy("doc_id", "key", "side", "source_page").agg(F.lit(1).alias("one")).groupBy("doc_id", "key", "side").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_pages).select("doc_id", "key").distinct()


def furniture(edge_rows: DataFrame) -> DataFrame:
    """section_key, field, line_no, kind of running titles and page numbers: the outermost lines of a page, one after the other."""
    marked = edge_rows.join(titles(edge_rows).withColumn("title", F.lit(True)), ["doc_id", "key"], "left")
    kind = F.when(F.col("title"), "header").when(F.col("number"), "page_number")
    page = marked.groupBy("section_key", "doc_id", "source_page", "field").agg(F.array_sort(F.collect_list(F.struct("line_no", kind.alias("kind"), "top", "foot"))).alias("l"))

    def run(from_foot: bool) -> Column:
        items = F.reverse("l") if from_foot else F.col("l")
        side = "foot" if from_foot else "top"
        free = F.transform(items, lambda s: F.when((s["kind"].isNotNull()) & (s[side] < EDGE), 0).otherwise(1))
        stop = F.array_position(free, 1)
        return F.when(stop == 0, items).otherwise(F.slice(items, F.lit(1), (stop - 1).cast("int")))

    found = page.select("section_key", "field", F.explode(F.array_distinct(F.concat(run(False), run(True)))).alias("x"))
    return found.select("section_key", "field", "x.line_no", "x.kind").distinct()


def body(text: str, field: str, drop: set[int]) -> list[tuple[int, str]]:
    """(line number, line) of the lines that are prose, in order; blank ones as empty strings."""
    lines = text.split("\n")
    out = []
    if field == "raw_text":
        for i, x in enumerate(lines, 1):
            if i not in drop:
                out.append((i, charforms.canonical_line(x) if not x.isascii() else x))
        return out
    inside = _blocks(text) if re.search(r"[`~$|\\<{]", text) else set()
    for i, x in enumerate(lines, 1):
        if i not in drop and i not in inside:
            x = _TAGS.sub(" ", x)
            out.append((i, charforms.canonical_line(x) if not x.isascii() else x))
    return out


def _blocks(text: str) -> set[int]:
    """Numbers of the lines within code, formulas and tables."""
    out: set[int] = set()
    lines = text.split("\n")
    at = 0
    for n in markup.parse(text):
        if n.kind in ("code", "formula", "table") and n.body.strip():
            for part in n.body.split("\n"):
                p = part.strip()
                if not p:
                    continue
                for k in range(at, len(lines)):
                    if p in lines[k]:
                        out.add(k + 1)
                        at = k
                        break
    return {i for i in out if n_words_outside(lines[i - 1]) < 4}


def n_words_outside(line: str) -> int:
    """Words of a line that stand outside of marks, cells and formulas."""
    if "|" in line or "&" in line or line.lstrip().startswith(("<t", "\\", "$$")):
        return 0
    return len(re.findall(r"[^\W\d_]{3,}", _TAGS.sub(" ", line)))


def _words(line: str) -> list[str]:
    if "/" in line or "_" in line or "@" in line or "\\" in line:
        line = _NAMES.sub(" ", line)
    return _WORD.findall(line.lower().replace("’", "'"))


PASS = "kind string, w1 string, w2 string, n bigint, section_key bigint, doc_id bigint, source_page int, field string, region int, line_no int, to_line int"


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (u) and pairs (b); cut words (h), those at a page's end (e), first words of pages (f)."""
    schema = pa.schema([("kind", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("n", pa.int64()), ("section_key", pa.int64()), ("doc_id", pa.int64()), ("source_page", pa.int32()), ("field", pa.string()), ("region", pa.int32()), ("line_no", pa.int32()), ("to_line", pa.int32())])
    one: Counter = Counter()
    two: Counter = Counter()

    def flush() -> list[pa.RecordBatch]:
        rows = [("u", w, None, n, None, None, None, None, None, None, None) for w, n in one.items()] + [("b", a, b, n, None, None, None, None, None, None, None) for (a, b), n in two.items()]
        one.clear()
        two.clear()
        return [_batch(rows, schema)] if rows else []

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            where = (r["section_key"], r["doc_id"], r["source_page"], r["field"], r["region"])
            lines = [(i, x) for i, x in body(r["text"], r["field"], set(r["drop"] or ())) if x.strip()]
            cut_before = False
            for k, (i, x) in enumerate(lines):
                words = _words(x)
                m = _CUT.search(x) if x.rstrip(" \t")[-1:] in _MARKS else None
                if k == 0 and r["field"] != "image_markdown" and (g := _GO_ON.match(x)):
                    out.append(("f", g[1].lower(), None, None, *where, i, None))
                plain = words[1:] if cut_before else words
                if m and plain:
                    plain = plain[:-1]
                one.update(plain)
                if "-" in x or "\u2010" in x or "\u2011" in x:
                    one.update(c.lower() for c in _COMPOUND.findall(x if not m else x[: m.start()]))
                two.update(zip(plain, plain[1:], strict=False))
                if m:
                    if k + 1 < len(lines):
                        g = _GO_ON.match(lines[k + 1][1])
                        if g:
                            out.append(("h", m[1].lower(), g[1].lower(), None, *where, i, lines[k + 1][0]))
                    elif r["field"] != "image_markdown":
                        out.append(("e", m[1].lower(), None, None, *where, i, None))
                cut_before = bool(m)
        if out:
            yield _batch(out, schema)
        if len(one) + len(two) > 200_000:
            yield from flush()
    yield from flush()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.types[k]) for k in range(len(schema))], schema=schema)


#: Figures and the letters they are taken for, as one.
_ONE_KEY = str.maketrans("01i56892", "ollsbbgz")
_SIDES = [sorted({p[side].translate(_ONE_KEY) for p in PAIRS if len(p[side]) > 1}) for side in (0, 1)]
_SPOTS = [{p[side].translate(_ONE_KEY) for p in PAIRS} for side in (0, 1)]


def _deletes(word: str, side: int) -> set[str]:
    """Keys of a word: itself, without any one or two letters or confusable stretches; side 0 as read, 1 as meant.

    Of short words two at once are only taken out where recognition confuses them, as two other edits are beyond their limit."""
    w = word.translate(_ONE_KEY)
    ops = [(i, 1) for i in range(len(w))] + [(i, len(p)) for p in _SIDES[side] for i in range(len(w) - len(p) + 1) if w.startswith(p, i)]
    keys = {w} | {w[:i] + w[i + n :] for i, n in ops}
    if len(w) < GENERAL:
        ops = [(i, n) for i, n in ops if w[i : i + n] in _SPOTS[side]]
    for i, n in ops:
        head = w[:i]
        for j, m in ops:
            if j >= i + n:
                keys.add(head + w[i + n : j] + w[j + m :])
    return keys


#: Words beyond so many letters meet by segments: of five of a word two edits leave one as it is, so this finds all that deletes would, in keys whose number doesn't grow with the word.
LONG, SEGMENTS, SHIFT = 32, 5, 4


def _keys(word: str, side: int) -> set[str]:
    """All keys of a word: deletes, segments if it is long, both if it may meet words of either kind."""
    n = len(word)
    if side == 0:
        return _deletes(word, 0) if n <= LONG else _segments(word, 0)
    return (_deletes(word, 1) if n <= LONG + SHIFT else set()) | (_segments(word, 1) if n > LONG - SHIFT else set())


def _segments(word: str, side: int) -> set[str]:
    """Segments of a long word with its length; of one as read, whatever may be a segment of a word that differs by two edits."""
    w = word.translate(_ONE_KEY)
    keys = set()
    for m in range(len(w) - SHIFT, len(w) + SHIFT + 1) if side == 0 else (len(w),):
        for k in range(SEGMENTS):
            a, b = k * m // SEGMENTS, (k + 1) * m // SEGMENTS
            for s in range(-SHIFT, SHIFT + 1) if side == 0 else (0,):
                if 0 <= a + s and b + s <= len(w):
                    keys.add(f"{m} {k} {w[a + s : b + s]}")
    return keys


def _keyed(side: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """word, n, key of each word: as many rows as it has keys, some words at a time."""
        for b in batches:
            words, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(words), 100):
                rows = [(w, n, int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big", signed=True)) for w, n in zip(words[k : k + 100], counts[k : k + 100], strict=True) for key in _keys(w, side)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["word", "n", "key"])

    return keys


#: Letters by which two words may be shifted against each other within any limit.
BAND = 12
_BY_FIRST: dict[str, list[tuple[str, str, float]]] = {}
for (_a, _b), _w in PAIRS.items():
    _BY_FIRST.setdefault(_a[0], []).append((_a, _b, _w))


def distance(read: str, meant: str, other: float = 1.0) -> float:
    """Weighted edit distance: confusion pairs by their weight, any other edit of a letter and a swap of two neighbours ``other``."""
    n, m = len(read), len(meant)
    k = 0
    while k < min(n, m) and read[k] == meant[k]:
        k += 1
    k = max(0, k - 2)  # equal ends are left out, but for what a pair may reach
    e = 0
    while e < min(n, m) - k and read[n - 1 - e] == meant[m - 1 - e]:
        e += 1
    e = max(0, e - 2)
    read, meant = read[k : n - e], meant[k : m - e]
    n, m = len(read), len(meant)
    best = [[math.inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        row, pairs = best[i], _BY_FIRST.get(read[i : i + 1], ()) if i < n else ()
        for j in range(max(0, i - BAND), min(m, i + BAND) + 1):
            d = row[j]
            if d == math.inf:
                continue
            if i < n and d + other < best[i + 1][j]:
                best[i + 1][j] = d + other
            if j < m and d + other < row[j + 1]:
                row[j + 1] = d + other
            if i < n and j < m:
                step = d if read[i] == meant[j] else d + other
                if step < best[i + 1][j + 1]:
                    best[i + 1][j + 1] = step
                if i + 1 < n and j + 1 < m and read[i] == meant[j + 1] and read[i + 1] == meant[j] and d + other < best[i + 2][j + 2]:
                    best[i + 2][j + 2] = d + other
            for a, b, w in pairs:
                if d + w < math.inf and read.startswith(a, i) and meant.startswith(b, j) and d + w < best[i + len(a)][j + len(b)]:
                    best[i + len(a)][j + len(b)] = d + w
    return best[n][m]


def limit(word: str) -> float:
    return next(d for n, d in LIMITS if len(word) >= n)


def repairable(read: str, meant: str) -> tuple[float, bool] | None:
    """The distance if it is within the word's limit, and whether edits other than confusion pairs are needed; None if it isn't."""
    most = limit(read)
    d = distance(read, meant, math.inf)
    if d <= min(most, 1.2):
        return d, False
    if len(read) < GENERAL or len(meant) < GENERAL or not meant.isalpha():
        return None
    first, last = INNER
    if read[:first] != meant[:first] or read[-last:] != meant[-last:]:
        return None
    # an accent more or less is another word rather than a misread one
    if charforms_plain(read) == charforms_plain(meant):
        return None
    d = distance(read, meant)
    return (d, True) if d <= most else None


def charforms_plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (word, n, meant, n_meant) those within the limit, with distance and whether other edits are needed."""
    for batch in batches:
        rows = [(*r.values(), *f) for r in batch.to_pylist() if (f := repairable(r["word"], r["meant"]))]
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["word", "n", "meant", "n_meant", "d", "other"])


class Lexicon:
    """The corpus counts and what follows from them; each part is kept as a checkpoint, as it is read more than once."""

    def __init__(self, sections: DataFrame, common: int = COMMON):
        checkpoint_dir(sections.sparkSession)
        self.pages = pages(sections)
        self.edges = edges(self.pages).checkpoint()
        self.furniture = furniture(self.edges).checkpoint()
        drop = self.furniture.groupBy("section_key", "field").agg(F.collect_set("line_no").alias("drop"))
        self.prose = self.pages.join(drop, ["section_key", "field"], "left")
        self.passed = self.prose.select("section_key", "doc_id", "source_page", "field", "region", "text", "drop").mapInArrow(_count_pass, PASS).checkpoint()
        self.words = self.passed.where("kind = 'u'").groupBy(F.col("w1").alias("word")).agg(F.sum("n").alias("n")).checkpoint()
        self.cuts = self._cuts()
        near = self._candidates().checkpoint()
        order = Window.partitionBy("word").orderBy(F.col("d") - 0.05 * F.log("n_meant"), "meant")
        self.candidates = near.where("not other").withColumn("rank", F.row_number().over(order)).checkpoint()
        # by other edits only where no confusion pairs explain a word
        self.general = near.where(F.col("other") & (F.col("n_meant") >= F.col("n") * GENERAL_RATIO)).join(self.candidates.select("word").distinct(), "word", "left_anti").checkpoint()
        unsure = self.candidates.select("word").unionByName(self.general.select("word")).distinct()
        top = self.words.join(unsure, "word", "left_anti").where("n >= 2").orderBy(F.desc("n"), "word").limit(common)
        #: The most frequent words that can't be misread: bounded by the parameter.
        self.common = {r["word"]: r["n"] for r in top.collect()}
        # of the common words those that are several go (at most as many as there are common words); then longer ones part at them too
        for r in self.parted().join(top, "word").select("word").collect():
            del self.common[r["word"]]
        near = self.parted().checkpoint()
        # what the common words don't part, the whole lexicon may; such words are no common ones either
        far = self.parted_by_key(near).checkpoint()
        for r in far.join(top, "word").select("word").collect():
            self.common.pop(r["word"], None)
        self.lost = near.unionByName(far)

    def _cuts(self) -> DataFrame:
        """Cut words with what goes on, within a page and over its end: the joined and the hyphenated word with their counts."""
        here = self.passed.where("kind = 'h'").select("section_key", "field", "region", "line_no", "to_line", "w1", "w2", F.col("section_key").alias("to_section"))
        ends = self.passed.where("kind = 'e'").select("section_key", "doc_id", "source_page", "field", "region", "line_no", "w1")
        firsts = self.passed.where("kind = 'f'").select("doc_id", (F.col("source_page") - 1).alias("source_page"), "field", F.col("w1").alias("w2"), F.col("line_no").alias("to_line"), F.col("section_key").alias("to_section"))
        over = ends.join(firsts, ["doc_id", "source_page", "field"]).select("section_key", "field", "region", "line_no", "to_line", "w1", "w2", "to_section")
        both = here.unionByName(over).where(F.col("w2").rlike(r"\p{L}")).withColumn("word", F.concat("w1", "w2")).withColumn("with_hyphen", F.concat_ws("-", "w1", "w2"))
        n = lambda name, out: self.words.select(F.col("word").alias(name), F.col("n").alias(out))
        return both.join(n("word", "n_joined"), "word", "left").join(n("with_hyphen", "n_hyphen"), "with_hyphen", "left").fillna(0, ["n_joined", "n_hyphen"]).checkpoint()

    def _candidates(self) -> DataFrame:
        """word, n, meant, n_meant, d, other: all repairs of rare words, and whether other edits than confusion pairs are needed."""
        rare = self.words.where(~F.col("word").contains("-")).unionByName(self.cuts.where("n_joined = 0 and n_hyphen = 0").select("word", F.lit(1).cast("bigint").alias("n")).distinct())
        spaced = rare.where(F.col("word").rlike(_SPACED.pattern) & (F.length("word") >= 2) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike("^[ivxlcdm]+$"))
        rare = spaced.groupBy("word").agg(F.max("n").alias("n"))
        meant = self.words.where((F.col("n") >= LEAST) & F.col("word").rlike(_SPACED.pattern) & F.col("word").rlike(r"^[\p{L}']+$") & (F.length("word") >= 2)).select("word", "n")
        # no word is so rare that the most frequent one isn't often enough more frequent
        most = meant.agg((F.max("n") / RATIO).alias("most"))
        rare = rare.join(most, F.col("n") <= F.col("most")).select("word", "n")
        a = rare.mapInArrow(_keyed(0), "word string, n bigint, key bigint")
        b = meant.mapInArrow(_keyed(1), "word string, n bigint, key bigint").withColumnsRenamed({"word": "meant", "n": "n_meant"})
        met = a.join(b, "key").where((F.col("word") != F.col("meant")) & (F.col("n_meant") >= F.col("n") * RATIO)).select("word", "n", "meant", "n_meant").distinct()
        # a map, so that no filter on it is moved before the pairs are made distinct
        return met.mapInArrow(_fitting, "word string, n bigint, meant string, n_meant bigint, d double, other boolean")

    def parted(self) -> DataFrame:
        """word, parts: words that are several common words without their blanks, each pair of them known."""
        known = self.common
        total = sum(known.values()) or 1
        longest = max(map(len, known), default=0)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([part_word(w, known, total, longest) for w in words], pa.list_(pa.string()))], names=["word", "parts"])

        return self._known(self._runs().mapInArrow(part, "word string, parts array<string>").where(F.size("parts") > 1))

    def parted_by_key(self, lost: DataFrame) -> DataFrame:
        """word, parts: the same by the whole lexicon, of the words that aren't lost already: their substrings meet its words by key."""
        runs = self._runs().join(lost, "word", "left_anti")
        total = self.words.agg(F.sum("n")).first()[0] or 1
        whole = self.words.join(lost, "word", "left_anti").select(F.col("word").alias("part"), F.col("n").alias("c"))
        # a part is as long as some word: at most as many lengths as the longest word has letters
        lengths = sorted(r["k"] for r in whole.select(F.length("part").alias("k")).distinct().collect())
        runs = runs.withColumn("id", F.xxhash64("word"))
        met = runs.mapInArrow(_substrings(lengths), "id bigint, part string").join(whole, "part")

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def part(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for words, known in batches:
                yield pa.array([part_word(w, {x["part"]: x["c"] for x in k}, total) for w, k in zip(words.to_pylist(), known.to_pylist(), strict=True)], pa.list_(pa.string()))

        each = met.groupBy("id").agg(F.collect_list(F.struct("part", "c")).alias("known")).join(runs, "id")
        split = each.select("word", part("word", "known").alias("parts")).where(F.size("parts") > 1)
        return self._known(split.checkpoint())  # read twice

    def _runs(self) -> DataFrame:
        """word: what may be several words."""
        free = self.words.join(self.candidates.select("word").distinct(), "word", "left_anti")
        return free.where(F.col("word").rlike(_SPACED.pattern) & F.col("word").rlike(r"^[\p{L}']+$") & (F.length("word") >= 5)).select("word")

    def _known(self, split: DataFrame) -> DataFrame:
        """Of words with their parts those whose pairs speak for the parts."""
        # a word more frequent than the pair it would be is a word
        pairs = split.select("word", F.posexplode(F.zip_with(F.slice("parts", F.lit(1), F.size("parts") - 1), F.slice("parts", F.lit(2), F.size("parts") - 1), lambda x, y: F.struct(x.alias("w1"), y.alias("w2")))).alias("i", "p"))
        seen = pairs.select("word", "i", "p.w1", "p.w2").join(self.pairs(), ["w1", "w2"], "left")
        n_pair = F.coalesce("n", F.lit(0))
        ok = seen.groupBy("word").agg(F.min(n_pair).alias("least"), F.count_if(n_pair == 0).alias("unseen"), F.count("*").alias("k"), F.min(F.least(F.length("w1"), F.length("w2"))).alias("short"))
        known_pairs = (F.col("least") > F.col("n")) & (F.col("least") >= 2)
        almost = (F.col("k") >= 2) & (F.col("unseen") <= 1) & (F.col("n") <= 3)
        long_parts = (F.col("least") <= 1) & (F.col("short") >= 5) & (F.col("n") <= 2)
        return split.join(ok, "word").join(self.words, "word").where(known_pairs | almost | long_parts).select("word", "parts")

    def pairs(self) -> DataFrame:
        """w1, w2, n of all pairs of words side by side."""
        return self.passed.where("kind = 'b'").groupBy("w1", "w2").agg(F.sum("n").alias("n"))

    def occurrences(self) -> DataFrame:
        """Each word that isn't common, where it stands, with its neighbours; cut words joined."""
        known = frozenset(self.common)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("section_key", pa.int64()), ("field", pa.string()), ("region", pa.int32()), ("line_no", pa.int32()), ("pos", pa.int32()), ("word", pa.string()), ("before", pa.string()), ("after", pa.string())])
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    cut = False
                    for i, x in body(r["text"], r["field"], set(r["drop"] or ())):
                        if not x.strip():
                            continue
                        words = _words(x)
                        m = _CUT.search(x) if x.rstrip(" \t")[-1:] in _MARKS else None
                        last = len(words) - (1 if m else 0)
                        rest = {w for w in set(words).difference(known) if not w.isdigit() and _SPACED.match(w)}
                        for k in range(1 if cut else 0, last) if rest else ():
                            w = words[k]
                            if w in rest:
                                out.append((r["section_key"], r["field"], r["region"], i, k, w, words[k - 1] if k else None, words[k + 1] if k + 1 < len(words) else None))
                        cut = bool(m)
                if out:
                    yield _batch(out, schema)

        return self.prose.select("section_key", "field", "region", "text", "drop").mapInArrow(emit, "section_key bigint, field string, region int, line_no int, pos int, word string, before string, after string")

    def repairs(self) -> DataFrame:
        """section_key, field, region, line_no, pos, word, repair of each misread word and each word that lost its blanks."""
        seen = self.seen = self.seen if hasattr(self, "seen") else self.occurrences().checkpoint()
        one = self.candidates.groupBy("word").agg(F.count("*").alias("k"), F.min_by("meant", "rank").alias("best"))
        hit = seen.join(one, "word")
        plain = hit.where("k = 1").select("section_key", "field", "region", "line_no", "pos", "word", F.col("best").alias("repair"))
        # several candidates: what stands beside the word decides
        many = hit.where("k > 1").drop("k", "best").join(self.candidates.select("word", "meant", "n_meant", "d"), "word")
        pairs = self.pairs()
        left = pairs.select(F.col("w1").alias("before"), F.col("w2").alias("meant"), F.col("n").alias("n_left"))
        right = pairs.select(F.col("w1").alias("meant"), F.col("w2").alias("after"), F.col("n").alias("n_right"))
        scored = many.join(left, ["before", "meant"], "left").join(right, ["meant", "after"], "left")
        score = F.log1p(F.coalesce("n_left", F.lit(0))) + F.log1p(F.coalesce("n_right", F.lit(0))) + 0.5 * F.log("n_meant") - 6 * F.col("d")
        picked = scored.groupBy("section_key", "field", "region", "line_no", "pos", "word").agg(F.max_by("meant", F.struct(score, "meant")).alias("repair"))
        lost = seen.join(self.lost, "word").select("section_key", "field", "region", "line_no", "pos", "word", F.array_join("parts", " ").alias("repair"))
        # by other edits: what stands on both sides must know the repair, better than the word itself
        other = seen.join(self.general.select("word", "n", "meant", "n_meant", "d"), "word").join(self.lost.select("word"), "word", "left_anti")
        own_left = pairs.select(F.col("w1").alias("before"), F.col("w2").alias("word"), F.col("n").alias("own_left"))
        own_right = pairs.select(F.col("w1").alias("word"), F.col("w2").alias("after"), F.col("n").alias("own_right"))
        known = other.join(left, ["before", "meant"], "left").join(right, ["meant", "after"], "left").join(own_left, ["before", "word"], "left").join(own_right, ["word", "after"], "left")
        speaks = lambda side, n, own: F.col(side).isNull() | (F.coalesce(n, F.lit(0)) >= F.lit(CONTEXT) * F.coalesce(own, F.lit(1)))
        known = known.where((F.col("before").isNotNull() | F.col("after").isNotNull()) & speaks("before", F.col("n_left"), F.col("own_left")) & speaks("after", F.col("n_right"), F.col("own_right")))
        by_context = known.groupBy("section_key", "field", "region", "line_no", "pos", "word").agg(F.max_by("meant", F.struct(score, "meant")).alias("repair"))
        return plain.unionByName(picked).unionByName(lost).unionByName(by_context)

    def joined(self) -> DataFrame:
        """The cut words that are written as one: with the whole word, and in which part it is misread if it is."""
        fixed = self.candidates.where("rank = 1").select("word", "meant")
        known = self.cuts.join(fixed, "word", "left").withColumn("whole", F.coalesce("meant", "word"))
        compound = F.col("n_hyphen") > F.col("n_joined")
        one = (F.col("n_joined") > 0) | F.col("meant").isNotNull()
        # of neither form known: a part that is no word of its own was cut
        parts = self.words.where(F.col("n") >= LEAST).select(F.col("word").alias("w1"), F.lit(True).alias("w1_known")), self.words.where(F.col("n") >= LEAST).select(F.col("word").alias("w2"), F.lit(True).alias("w2_known"))
        rows = known.join(parts[0], "w1", "left").join(parts[1], "w2", "left")
        loose = ~(F.coalesce("w1_known", F.lit(False)) & F.coalesce("w2_known", F.lit(False))) & ~F.col("w2").rlike(r"^\p{Nd}+$")
        rows = rows.where(~compound & (one | loose))
        same = F.col("whole").startswith(F.col("w1"))
        bad = F.when(F.col("whole") == F.col("word"), F.lit(None)).when(same, F.lit("w2")).otherwise(F.lit("w1"))
        return rows.select("section_key", "field", "region", "line_no", "to_section", "to_line", "w1", "w2", "whole", bad.alias("bad"))


def _substrings(lengths: list[int]):
    """The id of each word with all the word's shorter pieces of these lengths that may be a part; a bounded number of rows at a time."""

    def batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "part"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, str]] = []
            for r in b.to_pylist():
                w = r["word"]
                for n in lengths:
                    if n < len(w):
                        rows += [(r["id"], p) for p in {w[i : i + n] for i in range(len(w) - n + 1)} if n > 1 or p in ALONE]
                    if len(rows) > 20_000:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    return emit


def part_word(word: str, known: dict[str, int], total: int, longest: int | None = None) -> list[str]:
    """The likeliest way to part a word into known words of two letters or more (or of one that stands alone); the word itself if none."""
    n = len(word)
    longest = max(map(len, known), default=0) if longest is None else longest
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * n
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            w = word[start:end]
            c = known.get(w) if end - start < n else None
            if c is None or best[start][0] == -math.inf or (len(w) == 1 and w not in ALONE) or (len(w) <= 3 and c < 20):
                continue
            s = best[start][0] + math.log(c / total) - 1
            if s > best[end][0]:
                best[end] = (s, start)
    if best[n][0] == -math.inf:
        return [word]
    out, end = [], n
    while end:
        start = best[end][1]
        out.append(word[start:end])
        end = start
    return out[::-1] if len(out) > 1 else [word]


def found_lines(sections: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """section_key, field, region, line_no, kind of each noisy line."""
    x = lexicon or Lexicon(sections)
    edge = x.furniture.select("section_key", "field", F.lit(0).alias("region"), "line_no", "kind")
    joined = x.joined().checkpoint()
    cut = joined.select("section_key", "field", "region", "line_no", F.lit("hyphen").alias("kind"))
    wrong = joined.where("bad is not null").select(F.when(F.col("bad") == "w1", F.col("section_key")).otherwise(F.col("to_section")).alias("section_key"), "field", "region", F.when(F.col("bad") == "w1", F.col("line_no")).otherwise(F.col("to_line")).alias("line_no"), F.lit("misread").alias("kind"))
    misread = x.repairs().select("section_key", "field", "region", "line_no", F.lit("misread").alias("kind"))
    return edge.unionByName(cut).unionByName(wrong).unionByName(misread).distinct()


TEXT = T.StringType()


@F.arrow_udf(TEXT)
def _render(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for text, field, drop, fixes, out_cuts, in_cuts in batches:
        rows = zip(*(x.to_pylist() for x in (text, field, drop, fixes, out_cuts, in_cuts)), strict=True)
        yield pa.array([None if t is None else repair_text(t, f, set(d or ()), x or [], o or [], i or []) for t, f, d, x, o, i in rows], pa.string())


def repair_text(text: str, field: str, drop: set[int], fixes: list[dict], out_cuts: list[dict], in_cuts: list[dict]) -> str:
    """A page's text in paragraphs: without furniture, cut words joined, misread words replaced in their letter case."""
    by_line: dict[int, dict[int, str]] = {}
    for x in fixes:
        if x["repair"]:
            by_line.setdefault(x["line_no"], {})[x["pos"]] = x["repair"]
    whole = {c["line_no"]: c for c in out_cuts}
    gone = {c["to_line"] for c in in_cuts}
    lines = text.split("\n")
    inside = _blocks(text) if field != "raw_text" else set()
    paragraphs, now = [], []

    def end() -> None:
        if now:
            paragraphs.append(" ".join(now))
            now.clear()

    mean = sum(map(len, lines)) / max(1, len(lines))
    for i, line in enumerate(lines, 1):
        if i in drop:
            continue
        if not line.strip():
            end()
            continue
        if i in inside:
            end()
            paragraphs.append(line)
            continue
        x = charforms.canonical_line(line)
        if i in by_line:
            own = by_line[i]
            k = -1

            def put(m: re.Match, own: dict[int, str] = own) -> str:
                nonlocal k
                k += 1
                new = own.get(k)
                return m.group() if new is None else new.upper() if m.group().isupper() and len(m.group()) > 2 else new[:1].upper() + new[1:] if m.group()[:1].isupper() else new

            spans = [(m.start(), m.end()) for m in _NAMES.finditer(x)]
            x = _WORD.sub(lambda m, spans=spans: m.group() if any(a <= m.start() < b for a, b in spans) else put(m), x)
        if i in gone:
            x = re.sub(r"^(\W*)[^\W_]+(?:['’][^\W_]+)*(\W?)\s*", r"\2 ", x).strip()
        if i in whole:
            w = whole[i]
            head = x[: _CUT.search(x).start()] if _CUT.search(x) else x
            new = w["whole"]
            x = head + (new[:1].upper() + new[1:] if w["w1"][:1] and (m := _CUT.search(line)) and m[1][:1].isupper() else new)
        now.append(x.strip())
        if re.search(r"[.!?:。！？]['”»\")]?\s*$", x) and len(line) < 0.6 * mean:
            end()
    end()
    return "\n\n".join(p for p in paragraphs if p.strip())


def repaired(sections: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """section_key, field, region, text: each field in continuous paragraphs of right words.

    What is gathered for a page are its own fixes, as many as its lines at most times its words."""
    x = lexicon or Lexicon(sections)
    key = ["section_key", "field", "region"]
    fixes = x.repairs().where("repair is not null").groupBy(*key).agg(F.collect_list(F.struct("line_no", "pos", "repair")).alias("fixes"))
    joined = x.joined()
    out_cuts = joined.groupBy(*key).agg(F.collect_list(F.struct("line_no", "w1", "whole")).alias("out_cuts"))
    in_cuts = joined.groupBy(F.col("to_section").alias("section_key"), "field", "region").agg(F.collect_list(F.struct("to_line")).alias("in_cuts"))
    rows = x.prose.join(fixes, key, "left").join(out_cuts, key, "left").join(in_cuts, key, "left")
    return rows.select(*key, _render("text", "field", "drop", "fixes", "out_cuts", "in_cuts").alias("text"))
