"""Sentences of texts in many languages and scripts, in SQL expressions alone.

Method: what looks like an end of a sentence and isn't (points in decimals, file names,
initials and abbreviations, end marks within URLs, quotations and list items) is masked by a
private-use character, one for one, so that no offset moves; line breaks that part sentences
become another. The masked text is split by terminator patterns of its scripts, and the
sentences are cut from the text itself by the offsets, which restores all that was masked.
No Python and no shuffle; every pattern is free of unbounded repetition of groups, so that
long texts can't overflow the stack. Offsets are running sums in two levels (runs of about
as many pieces as there are runs), so that a very long text isn't a copy for each sentence.

Defined results: null, empty and blank texts have no sentences; a blank line always ends one,
a single line break only beside a list item; a list item is one sentence with its mark; quoted
matter doesn't end the sentence it stands in; Thai sentences end at blanks. Private-use
characters that the text itself has at the places used here count as letters. Repeated rows
give equal sentences; other columns aren't touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces that are folded at once; more go in runs, with the same result.
FOLD = 256

MASK, PART, OPEN, CLOSE, CUT, ITEM, OWN = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue00f"

# Abbreviations that never end a sentence, and those that don't before a figure.
NEVER = (
    "Dept Vol vol vs cf Cf e\\.g i\\.e approx ca Ca env bzw vgl Vgl Dr Mr Mrs Ms Prof Hr Fr Frau St Sr Sra Srta Mme Mlle Gen Gov Rev Capt Lt Col Sgt Messrs Jr\\.? viz Univ Inst Ref ref Kap Bd sog "
    "aprox Véase См см им ул Βλ βλ π\\.χ περ κ z\\.\\s?B d\\.\\s?h u\\.\\s?a o\\.\\s?ä p\\.\\s?ex p\\.\\s?ej т\\.\\s?е т\\.\\s?к resp incl excl"
).split()
# Names of companies' forms: no end before another of them or a comma.
COMPANY = "Corp Inc Ltd Co Cie Bros LLC Pty Plc".split()
BEFORE_FIGURE = "Jan Feb Febr Mar Apr Jun Jul Aug Sept Sep Okt Oct Nov Dez Dec Fig fig Figs Art art Arts arts No no Nos nos Nr nr Abs para paras Para chap Chap ch Ch cap Cap núm Núm n p pp P PP S Sec sec Sect Tab tab Eq eq рис Рис табл Табл стр ст гл п пп άρθ Άρθ σελ παρ Pos pos Ziff ziff lit Vol vol".split()
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
GERMAN_BEFORE_ORDINAL = "dem am Am den der vom Vom zum Zum des bis im Im".split()

_END = ".!?\u3002\uff01\uff1f\uff61\u0964\u0965\u061f\u06d4\u0589\u1362"
_CJK_END = "\u3002\uff01\uff1f\uff61"
_CLOSERS = CLOSE + ")\\]}\uff09\u3011\u300d\u300f\u00bb\u201d\u2019\"'"
_ITEM = r"[ \t]*(?:[-*\u2022\u00b7\u2023\u25aa\u25e6]|\(?(?:\p{L}|\p{Nd}{1,3}|[ivx]{1,4})\))[ \t]+(?=\S)"

_DOTS = (
    r"\.(?:"
    r"(?<=\p{Nd}\.)(?=\p{Nd})"  # decimals and numbers of parts
    r"|(?<=[\p{L}\p{N}_-]\.)(?=[\p{Ll}\p{Nd}])(?<![\u3040-\u9fff]\.)"  # hosts, files, e.g
    r"|(?<=[\u0900-\u097f]\.)"  # Devanagari has its own full stop
    r"|(?<=(?<![\p{L}\p{N}])\p{Lu}\.)(?=\s*\p{Lu}[\p{L}.])"  # initials
    f"|(?<=(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(NEVER)})\\.)"
    r"|(?<=(?<!\p{L})[zZ]\.)(?=\s?B\.)"
    f"|(?<=(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(BEFORE_FIGURE)})\\.)(?=\\s*\\p{{Nd}})"
    f"|(?<=(?<![\\p{{L}}])(?:{'|'.join(GERMAN_BEFORE_ORDINAL)})\\s\\p{{Nd}}{{1,2}}\\.)(?=\\s+\\p{{Lu}})"
    f"|(?<=(?<!\\p{{N}})\\p{{Nd}}{{1,2}}\\.)(?=\\s+(?:{'|'.join(MONTHS)}))"
    f"|(?<=(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(COMPANY)})\\.)(?=\\s*(?:,|(?:{'|'.join(COMPANY)})\\b))"
    r")"
)

#: The point behind the number of a heading, however far it is indented.
_NUMBERED = f"((?:\\A|[\\n{PART}{ITEM}])[ \\t]*+\\p{{Nd}}{{1,2}})\\.(?=[ \\t]+\\S)"
_IS_NUMBERED = f"(?:\\A|[\\n{PART}{ITEM}])[ \\t]*+\\p{{Nd}}{{1,2}}\\.[ \\t]"
#: End marks within a URL: of ASCII signs, up to the last one that is a letter, figure or sign of a path.
_URL = "((?:(?<![\\p{L}\\p{N}])(?:[A-Za-z][A-Za-z0-9+-]*+://|www\\.)|(?!\\A)\\G)[A-Za-z0-9/=&%_#~@:+,()*$-]*+)[.!?;](?=[.!?;]*+[A-Za-z0-9/=&%_#~@+$-])"

_STARTS = f"[\\p{{Lu}}\\p{{Lt}}\\p{{N}}\\p{{Sc}}\u00a7#{OPEN}(\\[\u00bf\u00a1\u00ab\u201c\u201e\"]|\\p{{Ll}}\\p{{Lu}}"
_ENDS = (
    "((?=[FIRST])(?:"
    f"[{_CJK_END}](?![{_CLOSERS}{_END}])"
    f"|[{_END}](?![{_CLOSERS}{_END}])(?=\\s+(?:{_STARTS}|\\p{{Lo}}))"
    # no blank after the end mark
    f"|\\.(?<=[\\p{{L}}\\p{{N}})]\\.)(?=\\p{{Lu}}[\\p{{L}}\u2019' ]|[{OPEN}\u00bf\u00a1]|\\p{{Lo}})"
    f"|[!?\u0964\u0965\u061f\u06d4](?=\\p{{Lu}}|\\p{{Lo}}|[{OPEN}\u00bf\u00a1])"
    # closing marks belong to the sentence; what goes on in lower case or at once goes on
    f"|[{_END}][ \u00a0\u202f]?[{_CLOSERS}]{{1,2}}(?![{_CLOSERS}{_END}])(?=\\s+(?:{_STARTS}))"
    f"|[;\u037e](?<=\\p{{IsGreek}}[;\u037e])(?=\\s+(?:{_STARTS}))"
    # Thai: a blank between sentences
    "|[\u0e01-\u0e2e\u0e30-\u0e45\u0e47-\u0e5b](?=[ \\t\u00a0]+[\u0e00-\u0e7f])"
    "))"
)
#: For texts without later scripts the first character is one of a few; a class of many is slow at each place.
_FEW_ENDS = _ENDS.replace("FIRST", ".!?;")
_ALL_ENDS = _ENDS.replace("FIRST", f"{_END};\u037e\u0e01-\u0e5b")
_LATER = "[\u037e\u0589-\u1fff\u3000-\uffdf]"
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000" + PART + ITEM

#: By opening mark: a quotation of any length, within a part.
_QUOTED = {a: f"{before}{a}([^{a}{b}{PART}]*+)[{b}]" for a, b, before in (("\u201e", "\u201c\u201d", ""), ("\u201c", "\u201d", ""), ("\u00ab", "\u00bb", ""), ("\u300c", "\u300d", ""), ("\u300e", "\u300f", ""), ('"', '"', ""))}
_QUOTED['"'] = f'"(?<![\\p{{L}}\\p{{N}}]")([^"{PART}]*+)"'


def _holds(text: Column, marks: str) -> Column:
    """Whether a text has one of the characters; bytes are searched, nothing is decoded."""
    out = text.contains(marks[0])
    for c in marks[1:]:
        out = out | text.contains(c)
    return out


def _holds_any(text: Column, parts: list[str]) -> Column:
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def masked(text: Column) -> Column:
    """The text with false ends masked and parting line breaks marked, character for character."""
    t = F.when(_holds(text, MASK + PART + OPEN + CLOSE + CUT + ITEM), F.translate(text, MASK + PART + OPEN + CLOSE + CUT + ITEM, OWN * 6)).otherwise(text)
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit(" \n")), F.lit("\r"), F.lit("\n"))
    # a part for each blank line: of empty ones by bytes, of those with blanks by pattern
    t = F.replace(t, F.lit("\n\n"), F.lit(PART + "\n"))
    odd = _holds_any(t, ["\n" + c for c in " \t\u00a0\u3000"])
    return F.when(odd, F.regexp_replace(t, r"\n(?=[ \t\u00a0\u3000]+\n)", PART)).otherwise(t)


def _items(t: Column) -> Column:
    """List items: their line breaks part, their inner ends are masked."""
    marked = F.regexp_replace(t, f"\\n(?={_ITEM})", ITEM)
    ended = F.regexp_replace(marked, f"((?:\\A|[\\n{PART}{ITEM}]){_ITEM}[^\\n{PART}{ITEM}]*)\\n", f"$1{PART}")
    return F.regexp_replace(ended, f"((?:[{PART}{ITEM}]{_ITEM}|\\A{_ITEM}|(?!\\A)\\G)[^\\n{PART}{ITEM}{_END};\u037e]*)[{_END};\u037e]", f"$1{MASK}")


def _quotes(t: DataFrame, out: str) -> DataFrame:
    """Quotations: their marks as one kind, ends within them masked, but for one right before the closing mark."""
    c = F.col(out)
    for opens, pattern in _QUOTED.items():
        t = t.withColumn(out, F.when(c.contains(opens), F.regexp_replace(c, pattern, f"{OPEN}$1{CLOSE}")).otherwise(c))
    # looked for once a quotation, not at each of its end marks: does it close before another opens
    inner = f"((?:{OPEN}(?=[^{OPEN}{CLOSE}]*+{CLOSE})|(?!\\A)\\G)[^{OPEN}{CLOSE}{_END}]*+)[{_END}](?!\\s*+{CLOSE})"
    return t.withColumn(out, F.when(c.contains(OPEN), F.regexp_replace(c, inner, f"$1{MASK}")).otherwise(c))


def with_ends(df: DataFrame, column: str = "text", out: str = "ends") -> DataFrame:
    """Adds the array of (start, end) of the sentences: characters, end excluded."""
    c = F.col(out)
    df = df.withColumn(out, masked(F.col(column)))
    df = df.withColumn(out, F.when(c.rlike(f"(?:\\A|[\\n{PART}]){_ITEM}"), _items(c)).otherwise(c))
    df = df.withColumn(out, F.when(_holds_any(c, ["://", "www."]), F.regexp_replace(c, _URL, f"$1{MASK}")).otherwise(c))
    df = _quotes(df, out)
    df = df.withColumn(out, F.when(c.rlike(_IS_NUMBERED), F.regexp_replace(c, _NUMBERED, f"$1{MASK}")).otherwise(c))
    df = df.withColumn(out, F.regexp_replace(c, _DOTS, MASK))
    df = df.withColumn(out, F.when(F.col(column).rlike(_LATER), F.regexp_replace(c, _ALL_ENDS, f"$1{CUT}")).otherwise(F.regexp_replace(c, _FEW_ENDS, f"$1{CUT}")))
    # a cut is no character of the text: it goes with the split, the parting line break stays and counts
    df = df.withColumn(out, F.split(F.replace(F.replace(c, F.lit(PART), F.lit(PART + CUT)), F.lit(ITEM), F.lit(ITEM + CUT)), CUT, -1))
    sizes = F.transform(c, lambda p: F.struct(F.length(p).alias("n"), F.length(F.rtrim(p, F.lit(_BLANKS))).alias("k"), F.length(F.ltrim(p, F.lit(_BLANKS))).alias("m")))
    df = df.withColumn(out, sizes)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def folded(pieces: Column, start: Column) -> Column:
        return F.aggregate(
            pieces,
            F.struct(start.alias("at"), empty.alias("a")),
            lambda s, p: F.struct((s["at"] + p["n"]).alias("at"), F.when(p["k"] > 0, F.concat(s["a"], F.array(F.struct((s["at"] + p["n"] - p["m"]).alias("start"), (s["at"] + p["k"]).alias("end"))))).otherwise(s["a"]).alias("a")),
            lambda s: s["a"],
        )

    # each step copies what was gathered, so many pieces are folded in runs: first where each run starts, then within it
    run = F.ceil(F.sqrt(F.size(c))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / run).cast("int")), lambda i: F.slice(c, i * run + 1, run))
    sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda a, p: a + p["n"]))
    starts = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    many = F.flatten(F.zip_with(runs, F.slice(starts, F.lit(1), F.size(starts) - 1), lambda r, at: folded(r, at)))
    df = df.withColumn(out, F.when(F.size(c) <= FOLD, folded(c, F.lit(0).cast("bigint"))).otherwise(many))
    return df.withColumn(out, F.coalesce(F.col(out), empty))


def sentence_ends(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """keys and end_char of each sentence."""
    base = with_ends(df.select(*keys, F.col(column).alias("_text")), "_text", "_ends")
    # outer: of an inner one the optimizer makes a filter on the array, pushes it down and computes the array twice
    return base.select(*keys, F.inline_outer("_ends")).where(F.col("end").isNotNull()).select(*keys, F.col("end").alias("end_char"))


def sentences(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """keys, sentence_no from 1, start, end_char and the sentence itself."""
    base = with_ends(df.select(*keys, F.col(column).alias("_text")), "_text", "_ends")
    rows = base.select(*keys, "_text", F.posexplode_outer("_ends").alias("_n", "_s")).where(F.col("_s").isNotNull())
    piece = F.substring("_text", (F.col("_s.start") + 1).cast("int"), (F.col("_s.end") - F.col("_s.start")).cast("int"))
    return rows.select(*keys, (F.col("_n") + 1).alias("sentence_no"), F.col("_s.start").alias("start_char"), F.col("_s.end").alias("end_char"), piece.alias("sentence"))
