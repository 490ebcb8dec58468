"""One form for text that looks the same.

Method: a quick-check class decides, in the JVM, which lines may be unstable (code points
whose normalization quick check is No or Maybe, or which stand for another of the same look).
Only those lines go to Arrow batches, where each unstable segment (a starter that is stable with
the run of unstable characters and marks behind it, or such a run at a line's start) is
isolated, normalized with the context at its boundaries (the base letter before a combining
mark, the script of the word and of the words beside it), and spliced into the text, which is
otherwise unchanged.

Kept as they are: words of other scripts, symbols named by a Greek letter, full-width
punctuation beside Chinese and Japanese, composed accents, typographic quotes, apostrophes and
long dashes, raised digits, fractions, degree signs, and joiners within scripts that need them.

Defined results: null stays null, an empty text stays empty; the form is idempotent; repeated
rows give equal results; other columns are not touched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of one look (Cyrillic, Greek -> Latin), and signs of one look.
CYRILLIC = dict(zip("аеорсухіѕјԁһԛԝӏАВЕКМНОРСТХУІЅЈԚԜ", "aeopcyxisjdhqwlABEKMHOPCTXYISJQW", strict=True))
GREEK = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX", strict=True))
SIGNS = {"\u2010": "-", "\u2011": "-", "\u2236": ":", "\u2215": "/", "\u037e": ";", "\u2024": ".", "\u01c3": "!", "\u201a": ","}
SPACES = "\u00a0\u2800\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u0085"
#: Default_Ignorable_Code_Point.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"

LETTERS = CYRILLIC | GREEK
_LOOKS = "".join(LETTERS)
#: Letters that only the one script has; a word with one of them is a real word of it.
#: Compatibility forms whose look is that of what they stand for, by the tag of their decomposition; of those tagged compat some blocks (digraphs, roman numerals, Hebrew symbols, radicals, ligatures).
_LOOK_TAGS = ("<font>", "<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
_COMPAT_BLOCKS = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2135, 0x2138), (0x2160, 0x217F), (0x2E80, 0x2FD5), (0xFB00, 0xFB17))


def _is_compat(c: str) -> bool:
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag == "<compat>":
        return any(a <= ord(c) <= b for a, b in _COMPAT_BLOCKS)
    if tag in ("<initial>", "<medial>", "<final>", "<isolated>"):  # some stand on a blank, or for a phrase
        return all(unicodedata.category(x)[0] in "LM" for x in unicodedata.normalize("NFKC", c))
    return tag in _LOOK_TAGS


def _ranges(codes: set[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def _classes() -> tuple[set[int], set[int], set[int]]:
    """Over all code points: compatibility forms, those with NFC_QC No or Maybe, those with a combining class."""
    compat, nfc, marks = set(range(0xFF01, 0xFFEF)), {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}, set()
    for k in range(0x80, 0x110000):
        c = chr(k)
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            marks.add(k)
        if not parts:
            continue
        if parts[0] == "<":
            if _is_compat(c):
                compat.add(k)
        elif unicodedata.normalize("NFC", c) != c:
            nfc.add(k)
        else:
            nfc.add(int(parts.split(" ")[-1], 16))  # composes with what stands before it
    return compat, nfc, marks


_COMPAT_CODES, _NFC_CODES, _MARK_CODES = _classes()
_COMPAT = "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(_COMPAT_CODES))

#: Quick check in Java's dialect: No or Maybe, marks that may be out of order; one class below U+2000 and one above, so that a character is compared with few ranges.
_J = lambda s: "".join(f"\\x{{{ord(c):x}}}" if c != "-" else "-" for c in s)
_J_CODES = lambda codes: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges(codes))
_UNSTABLE = {*map(ord, SPACES), *map(ord, SIGNS)} | _COMPAT_CODES | _NFC_CODES | {k for a, b in re.findall("(.)(?:-(.))?", INVISIBLE) for k in range(ord(a), ord(b or a) + 1)}
QUICK_CHECK = (
    f"[\\x{{80}}-\\x{{1fff}}&&[{_J_CODES({k for k in _UNSTABLE if k < 0x2000})}]]|[\\x{{2000}}-\\x{{10ffff}}&&[{_J_CODES({k for k in _UNSTABLE if k >= 0x2000})}]]"
    f"|[\\x{{300}}-\\x{{10ffff}}&&[{_J_CODES(_MARK_CODES)}]]{{2}}"
    r"|\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}"
    f"|(?<!\\p{{L}})[{_LOOKS}]+(?!\\p{{L}})"
)

#: A segment that NFC may change: with the starter before it, with which it may compose.
_SEGMENT = re.compile(f"[^\\n]?[{''.join(f'{chr(a)}-{chr(b)}' for a, b in _ranges(_NFC_CODES | _MARK_CODES))}]+")
_WORD = re.compile(r"[^\W\d_]+")
_HARD = re.compile(f"[{SPACES}{INVISIBLE}{_COMPAT}{''.join(map(re.escape, SIGNS))}]")
_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")
_OTHER = re.compile("[\u0370-\u03ff\u0400-\u052f]")
_REAL = re.compile(f"[\u0370-\u03ff\u0400-\u052f](?<![{_LOOKS}])")
_CJK = re.compile("[\u3001-\u30ff\u3400-\u9fff\uf900-\ufaff\uff0c\uff0e\uff1a\uff1b\uff01\uff1f\uac00-\ud7af]")
_JOINS = re.compile("[\u0600-\u06ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff\U0001f000-\U0001faff\u2600-\u27bf]")
_TAGGED = re.compile("\U0001f3f4[\U000e0020-\U000e007e]*$")
_BACK = {v: k for k, v in CYRILLIC.items() if k not in "іѕјԁһԛԝӏІЅЈԚԜ"}


def _sign(line: str, i: int) -> str:
    """What the unstable character at i becomes, from its neighbours."""
    c = line[i]
    before, after = line[i - 1 : i], line[i + 1 : i + 2]
    if "\U000e0020" <= c <= "\U000e007f":  # tags belong to a flag
        return c if _TAGGED.search(line[:i]) else ""
    if c in "\u200c\u200d" or "\ufe00" <= c <= "\ufe0f":
        return c if before and _JOINS.match(before) else ""
    if re.match(f"[{INVISIBLE}]", c):
        return ""
    if re.match(f"[{SPACES}]", c):
        return " "
    if c == "\u201a":  # a comma only after a word and before a blank; else a German quote
        return "," if before and (before.isalnum() or before in ")]}\"%\u201d\u2019") and not after.isalpha() else c
    if c in SIGNS:
        return SIGNS[c]
    if "\uff01" <= c <= "\uff60" and not unicodedata.normalize("NFKC", c).isalnum():
        near = [x for x in (before, after) if x]
        return c if any(_CJK.match(x) for x in near) else unicodedata.normalize("NFKC", c)
    if "\uff61" <= c <= "\uffdc":  # half-width kana and jamo
        return unicodedata.normalize("NFKC", c)
    if re.match(f"[{_COMPAT}]", c):
        return unicodedata.normalize("NFKC", c)
    return c


def _words(line: str) -> str:
    """Folds look-alike letters by the script of their word, or of the words beside it."""
    if not _OTHER.search(line):
        return line
    words = list(_WORD.finditer(line))
    out, at = [], 0
    for k, m in enumerate(words):
        w = m.group()
        if not _OTHER.search(w):
            continue
        real, latin = _REAL.search(w), _LATIN.search(w)
        if real and not latin:
            continue
        if real and latin:
            # more letters of the other script than Latin ones: the Latin ones stand for it
            others = sum(1 for c in w if _OTHER.match(c))
            new = "".join(_BACK.get(c, c) for c in w) if others * 2 > len(w) and not re.search("[\u0370-\u03ff]", w) else "".join(LETTERS.get(c, c) for c in w)
        elif latin:
            new = "".join(LETTERS.get(c, c) for c in w)
        else:
            beside = [words[j].group() for j in (k - 1, k + 1) if 0 <= j < len(words)]
            foreign = any(_OTHER.search(x) and not _LATIN.search(x) and _REAL.search(x) for x in beside)
            sign = len(w) == 1 and w.islower() and w in GREEK
            never = re.search("[іѕјԁһԛԝӏЅЈ]", w)
            if len(w) == 1 and not (k + 1 < len(words)):  # perhaps the first word of what goes on in the next line
                continue
            new = w if sign or (foreign and not never) or not (beside or never) else "".join(LETTERS.get(c, c) for c in w)
        if new != w:
            out += [line[at : m.start()], new]
            at = m.end()
    return "".join(out) + line[at:]


def _composed(line: str) -> str:
    """The line with each unstable segment in NFC."""
    return _SEGMENT.sub(lambda m: unicodedata.normalize("NFC", m.group()), line)


def canonical_line(line: str) -> str:
    """The one form of a line."""
    if line.isascii():
        return line
    out, at = [], 0
    for m in _HARD.finditer(line):
        if m.start() >= at and not unicodedata.combining(m.group()):
            new = _sign(line, m.start())
            if new != m.group():
                out += [line[at : m.start()], new]
                at = m.end()
    line = _composed("".join(out) + line[at:])
    # a letter that became Latin may compose with the mark behind it, and so make its word longer
    while (folded := _composed(_words(line))) != line:
        line = folded
    return line


def canonical_text(text: str) -> str:
    return "\n".join(map(canonical_line, text.split("\n")))


@F.arrow_udf(T.StringType())
def _canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if t is None else canonical_text(t) for t in texts.to_pylist()], pa.string())


def unstable(text: Column) -> Column:
    """Whether the quick check can't rule out that the text changes."""
    return F.coalesce(text.rlike(QUICK_CHECK), F.lit(False))


def with_canonical(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Adds (or replaces) the text in its one form. Stable texts reach Python as nulls and stay as they are."""
    text = F.col(column)
    return df.withColumn(out or column, F.coalesce(_canonical(F.when(unstable(text), text)), text))


def lines(df: DataFrame, column: str, keys: tuple[str, ...] = ("section_key",)) -> DataFrame:
    """Each line of a text with its number from 1; null texts have none."""
    return df.select(*keys, F.posexplode_outer(F.split(F.col(column), "\n", -1)).alias("_n", "line")).where(F.col("line").isNotNull()).select(*keys, (F.col("_n") + 1).cast("int").alias("line_no"), "line")


def changed_lines(df: DataFrame, column: str = "raw_text", keys: tuple[str, ...] = ("section_key",)) -> DataFrame:
    """Keys, line number, line and its one form of every line that isn't in its one form; repeated rows count once."""
    maybe = lines(df, column, keys).where(unstable(F.col("line")))
    return maybe.withColumn("canonical_line", _canonical("line")).where(F.col("canonical_line") != F.col("line")).dropDuplicates([*keys, "line_no"])
