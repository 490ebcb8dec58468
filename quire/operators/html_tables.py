"""HTML tables in text to grids of strings, merged cells with their places; fragments; pipe tables.

Reading HTML has state, so it runs in Arrow batches; grids come out as arrays and are taken
apart by built-in functions. Cells are never given a type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ROWS, MOST_COLUMNS = 10_000, 1_000
_MERGE = T.StructType([T.StructField(k, T.IntegerType()) for k in ("r1", "c1", "r2", "c2")])
GRID = T.StructType([T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("merges", T.ArrayType(_MERGE))])
PARSED = T.StructType([T.StructField("tables", T.ArrayType(GRID)), T.StructField("open", T.BooleanType()), T.StructField("error", T.StringType())])
_GRID_ARROW = pa.struct([("rows", pa.list_(pa.list_(pa.string()))), ("merges", pa.list_(pa.struct([(k, pa.int32()) for k in ("r1", "c1", "r2", "c2")])))])
_PARSED_ARROW = pa.struct([("tables", pa.list_(_GRID_ARROW)), ("open", pa.bool_()), ("error", pa.string())])


def place(rows: list[list[tuple[str, int, int]]]) -> dict | None:
    """Cells with spans to a full grid; a spanned place is an empty string. None of an empty table.

    ``busy`` holds, for each column, the row from which it is free again."""
    busy: list[int] = []
    values: dict[tuple[int, int], str] = {}
    merges = []
    for r, row in enumerate(rows):
        c = 0
        for value, high, wide in row:
            if high > MOST_ROWS or wide > MOST_COLUMNS:
                raise ValueError("unreasonable span")
            c = next((k for k in range(c, len(busy)) if busy[k] <= r), max(c, len(busy)))
            busy += [0] * (c + wide - len(busy))
            if max(busy[c : c + wide]) > r:
                raise ValueError("overlapping cells")
            busy[c : c + wide] = [r + high] * wide
            values[r, c] = value
            if (high, wide) != (1, 1):
                merges.append({"r1": r + 1, "c1": c + 1, "r2": r + high, "c2": c + wide})
            c += wide
    if not busy:
        return None
    return {"rows": [[values.get((y, x), "") for x in range(len(busy))] for y in range(max(busy))], "merges": merges}


class _Events(HTMLParser):
    """A text as a list of events: +tag with attributes, -tag, text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, object]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found.append((f"+{tag}", dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        self.found.append((f"-{tag}", None))

    def handle_data(self, data: str) -> None:
        self.found.append(("text", data))


def _since(events: list[tuple[str, object]], opens: tuple[str, ...], closes: tuple[str, ...]) -> Iterator[tuple[object, list]]:
    """For each closing event: the attributes of the last opening one, and what lies between. An opening that none closes gives nothing."""
    start = None
    for i, (kind, _) in enumerate(events):
        if kind in opens:
            start = i
        elif kind in closes and start is not None:
            yield events[start][1], events[start + 1 : i]
            start = None


def _cell(attributes: dict, inner: list) -> tuple[str, int, int]:
    text = "".join("\n" if kind == "+br" else value for kind, value in inner if kind in ("+br", "text"))
    high, wide = (max(1, int(attributes.get(k) or 1)) for k in ("rowspan", "colspan"))
    return text.strip(), high, wide


def read(html: str | None) -> dict:
    """tables, whether one is still open at the end, and the error of a table that can't be told."""
    parser = _Events()
    parser.feed(html or "")
    marks = [kind for kind, _ in parser.found if kind in ("+table", "-table")]
    if any(m == n == "+table" for m, n in zip(marks, marks[1:], strict=False)):
        return {"tables": [], "open": False, "error": "nested tables"}
    try:
        grids = []
        for _, body in _since(parser.found, ("+table",), ("-table",)):
            rows = [[_cell(a, x) for a, x in _since(row, ("+td", "+th"), ("-td", "-th"))] for _, row in _since(body, ("+tr",), ("-tr",))]
            grids.append(place(rows))
    except ValueError as e:
        return {"tables": [], "open": False, "error": str(e)}
    return {"tables": [g for g in grids if g], "open": marks[-1:] == ["+table"], "error": None}


_TABLE = re.compile(r"<table\b[^>]*>.*?</table>", re.I | re.S)
_WRAPPER = re.compile(r"</?(?:html|body|div)\b[^>]*>", re.I)
_IN_CELL = str.maketrans({"|": "\\|", "\n": "<br>"})


def pipe_table(grid: list[list[str]]) -> str:
    """A full grid as a pipe table under numbered columns, as no row of data is taken for a header."""
    width = len(grid[0])
    lines = [[f"Column {c}" for c in range(1, width + 1)], ["---"] * width, *([c.translate(_IN_CELL) for c in row] for row in grid)]
    return "".join(f"\n| {' | '.join(x)} |" for x in lines) + "\n"


def _shown(html: str) -> str:
    """A table as it is best read: a plain grid by pipes, one with merged cells as HTML with a line a row, one that can't be told as it is."""
    found = read(html)
    if found["error"]:
        return html
    plain = [g for g in found["tables"] if not g["merges"]]
    if len(plain) == len(found["tables"]) == 1:
        return pipe_table(plain[0]["rows"])
    return html.replace("</tr>", "</tr>\n")


def readable(text: str) -> str:
    """The text with each of its tables as it is best read; wrappers go."""
    parts, at = [], 0
    for table in _TABLE.finditer(text):
        parts += [text[at : table.start()], _shown(table.group())]
        at = table.end()
    return _WRAPPER.sub("", "".join([*parts, text[at:]])).strip()


def fragments(text: str) -> dict:
    """Prose and tables of a recognized text stacked to one grid; all of it is one cell if it has no whole table."""
    got = read(text)
    if not got["tables"] or got["open"] or got["error"]:
        return {"rows": [[text]], "merges": []}
    rows: list = []
    merges: list = []
    for part in re.split(r"(<table\b.*?</table>)", text, flags=re.I | re.S):
        if not part.strip():
            continue
        own = read(part)["tables"]
        for t in own:
            merges += [{k: v + (len(rows) if k[0] == "r" else 0) for k, v in m.items()} for m in t["merges"]]
            rows += t["rows"]
        if not own:
            rows.append([part.strip()])
    return {"rows": rows, "merges": merges}


@F.arrow_udf(PARSED)
def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([read(x) for x in b.to_pylist()], _PARSED_ARROW)


@F.arrow_udf(T.StringType())
def readable_markdown(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([None if x is None else readable(x) for x in b.to_pylist()], pa.string())


@F.arrow_udf(GRID)
def stacked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([None if x is None else fragments(x) for x in b.to_pylist()], _GRID_ARROW)


def cells(df: DataFrame, html: Column, keys: tuple[str, ...]) -> DataFrame:
    """keys, table_no, r, c (from 1), value of each table in an HTML text. Texts without a table don't reach Python."""
    some = df.where(F.lower(html).contains("<table")).select(*keys, parse(html).alias("p"))
    tables = some.select(*keys, F.posexplode("p.tables").alias("t", "g"))
    rows = tables.select(*keys, "t", F.posexplode("g.rows").alias("r", "row"))
    each = rows.select(*keys, "t", "r", F.posexplode("row").alias("c", "value"))
    return each.select(*keys, (F.col("t") + 1).alias("table_no"), (F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), "value")
