"""Texts over a size limit to pieces under it, cut where the text breaks, with overlap.

Method: pointer doubling. Every boundary of a text is joined to its farthest legal successor:
the piece that follows a cut at a boundary starts with the last ``overlap`` characters before
it, or with fewer where it can then start at a break, and ends at the last boundary of the
strongest kind in reach. That gives a successor table; squaring it again and again
(``table = table[table]``) while marking what the marked cuts reach gives all greedy cuts in
as many rounds as the logarithm of their number. All texts of an Arrow batch share one table,
so their cuts come out together, whatever the lengths.

Boundaries lie between two characters unless both are ASCII letters or digits, in falling
order of strength: after a blank line, a line break, the end of a sentence, a blank, any other
character. A run of letters and digits longer than the limit has no boundary to fall back on:
there, and only there, every place in the run is a boundary and a cut is ``forced``.

Only texts over the limit reach Python; the rest are one piece as they are.

Defined results: null texts have no pieces, a text within the limit (an empty one too) is one
piece. Pieces without their overlap join to the text exactly. Repeated rows give equal pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 2000
OVERLAP = 200
PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("forced", T.BooleanType())]))

_ENDS = np.array([ord(c) for c in ".!?。！？।؟۔"], np.uint32)
_BLANKS = np.array([9, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x202F, 0x3000, *range(0x2000, 0x200B)], np.uint32)
#: Strengths of boundaries.
NONE, MARK, BLANK, SENTENCE, LINE, PARAGRAPH = range(6)


def strengths(codes: np.ndarray) -> np.ndarray:
    """The strength of the boundary before each position 0..n."""
    n = len(codes)
    out = np.zeros(n + 1, np.int8)
    out[0] = out[n] = PARAGRAPH
    if n < 2:
        return out
    plain = ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
    blank = np.isin(codes, _BLANKS)
    line = codes == 10
    white = blank | line
    before, after = slice(0, n - 1), slice(1, n)
    inner = np.zeros(n - 1, np.int8)
    inner[~(plain[before] & plain[after])] = MARK
    inner[blank[before] & ~white[after]] = BLANK
    ended = np.isin(codes, _ENDS)
    # a boundary after "end mark, blank", or right after an end mark of a script without blanks
    inner[1:][ended[: n - 2] & blank[1 : n - 1] & ~white[2:]] = SENTENCE
    inner[np.isin(codes[before], _ENDS[3:]) & ~white[after]] = SENTENCE
    inner[line[before] & ~line[after]] = LINE
    inner[1:][line[: n - 2] & line[1 : n - 1] & ~line[2:]] = PARAGRAPH
    out[1:n] = inner
    # marks that combine with the character before aren't parted from it
    combining = (codes[after] >= 0x300) & (codes[after] <= 0x36F) | (codes[after] == 0x200D) | ((codes[after] >= 0xFE00) & (codes[after] <= 0xFE0F))
    out[1:n][combining & (out[1:n] == MARK)] = NONE
    return out


def cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int, bool]]]:
    """(start, end, forced) of the pieces of each text, by one table of successors for all of them."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    place, start_of, after, kind, offsets = [], [], [], [], [0]
    for t in texts:
        at, start, nxt, forced = _successors(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), limit, overlap)
        place.append(at)
        start_of.append(start)
        after.append(nxt + offsets[-1])
        kind.append(forced)
        offsets.append(offsets[-1] + len(at))
    if not texts:
        return []
    table = np.concatenate(after)
    hit = np.zeros(len(table), bool)
    hit[offsets[:-1]] = True
    count, step = len(texts), table
    while True:  # doubling: what is marked reaches 1, 2, 4, .. cuts farther
        hit[step[hit]] = True
        now = int(hit.sum())
        if now == count:
            break
        count, step = now, step[step]
    out = []
    for k in range(len(texts)):
        lo, hi = offsets[k], offsets[k + 1]
        on = np.flatnonzero(hit[lo:hi])
        at, start, forced = place[k], start_of[k], kind[k]
        out.append([(int(start[a]), int(at[b]), bool(forced[a])) for a, b in zip(on, on[1:], strict=False)])
    return out


def _successors(codes: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each boundary of a text: its place, the start of the piece after it, the index of that piece's end, whether that end is forced."""
    n = len(codes)
    strength = strengths(codes)
    natural = np.flatnonzero(strength)
    gap = np.diff(natural)
    # every place within a run over the limit; combining marks without end are such a run too
    extra = [np.arange(a + 1, a + g) for a, g in zip(natural[:-1][gap > limit], gap[gap > limit], strict=True)]
    at = np.sort(np.concatenate([natural, *extra])) if extra else natural
    m, s = len(at), strength[at]
    # the earliest break within the overlap before each boundary
    first = np.searchsorted(natural, at - overlap)
    start = np.minimum(natural[np.minimum(first, len(natural) - 1)], at)
    # from there the next break must be in reach, else the overlap gives way
    following = natural[np.minimum(np.searchsorted(natural, at, "right"), len(natural) - 1)]
    short = natural[np.minimum(np.searchsorted(natural, following - limit), len(natural) - 1)]
    start = np.maximum(start, np.minimum(short, at))
    # within a run over the limit: the last characters exactly
    inrun = following - np.where(s > 0, at, natural[np.maximum(np.searchsorted(natural, at, "right") - 1, 0)]) > limit
    exact = np.maximum(at - overlap, 0)
    at_break = natural[np.minimum(np.searchsorted(natural, exact), len(natural) - 1)]
    start = np.where(inrun, np.where(at_break <= at, at_break, exact), start)
    start[0] = 0
    reach = np.minimum(start + limit, n)
    end = np.full(m, -1, np.int64)
    floor = np.maximum(at, start + limit // 2)
    for level in (PARAGRAPH, LINE, SENTENCE, BLANK, MARK):
        own = natural[strength[natural] >= level]
        last = own[np.maximum(np.searchsorted(own, reach, "right") - 1, 0)]
        end = np.where((end < 0) & (last > floor), last, end)
    last = natural[np.maximum(np.searchsorted(natural, reach, "right") - 1, 0)]
    end = np.where((end < 0) & (last > at), last, end)
    end = np.where(reach >= n, n, end)
    forced = end < 0
    end = np.where(forced, reach, end)
    index = np.searchsorted(at, end)
    index[-1] = m - 1
    return at, start, index, forced


def _udf(limit: int, overlap: int):
    @F.arrow_udf(PIECES)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            out: list = [None] * len(texts)
            k = 0
            while k < len(texts):  # tables of some million boundaries at once
                group, size = [], 0
                while k < len(texts) and size < 1_000_000:
                    if texts[k] is not None:
                        group.append(k)
                        size += len(texts[k])
                    k += 1
                for i, found in zip(group, cuts([texts[i] for i in group], limit, overlap), strict=True):
                    out[i] = [{"start": a, "end": b, "forced": f} for a, b, f in found]
            yield pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("forced", pa.bool_())])))

    return pieces


def piece_spans(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """start and end (characters, end excluded) and whether the end is forced, of the pieces of texts over the limit; else null."""
    return _udf(limit, overlap)(F.when(F.length(text) > limit, text))


def fields(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("section_key",)) -> DataFrame:
    """keys, field, text: one row for each of the columns."""
    return df.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns))))


def pieces(df: DataFrame, columns: tuple[str, ...] = ("content", "layout_text"), keys: tuple[str, ...] = ("section_key",), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, field, piece_no from 1, start, end, overlap, forced, piece; repeated rows (by keys) count once."""
    base = fields(df.dropDuplicates(list(keys)), columns, keys).where(F.col("text").isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(False).alias("forced")))
    spans = base.withColumn("_spans", piece_spans(F.col("text"), limit, overlap)).withColumn("_spans", F.coalesce("_spans", whole))
    rows = spans.select(*keys, "field", "text", F.col("_spans").alias("_all"), F.posexplode("_spans").alias("_n", "_s"))
    before = F.when(F.col("_n") > 0, F.get("_all", F.col("_n") - 1)["end"] - F.col("_s.start")).otherwise(0)
    return rows.select(*keys, "field", (F.col("_n") + 1).alias("piece_no"), "_s.start", "_s.end", before.alias("overlap"), "_s.forced", F.substring("text", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")).alias("piece"))


def oversized(df: DataFrame, columns: tuple[str, ...] = ("content", "layout_text"), keys: tuple[str, ...] = ("section_key",), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, field, cut of each text over the limit: ``forced`` if a piece of it had to be cut within a run, else ``natural``."""
    big = fields(df, columns, keys).where(F.length("text") > limit)
    return big.withColumn("_spans", piece_spans(F.col("text"), limit, overlap)).select(*keys, "field", F.when(F.exists("_spans", lambda s: s["forced"]), "forced").otherwise("natural").alias("cut")).dropDuplicates([*keys, "field"])
