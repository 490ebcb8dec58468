"""Writers of documents and tables: JSON, Markdown, CSV with a byte order mark, XLSX.

Files are written by the tasks that hold their rows, under a temporary name that is then
renamed, so that a reader never sees half a file and a task may run again. ``folder`` must be
one that all executors share.
"""

from __future__ import annotations

import csv
import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

BOM = "\ufeff"
FORMATS = {"both": ("json", "md"), "json": ("json",), "md": ("md",), "csv": ("csv",), "xlsx": ("xlsx",)}


def formats(wanted: str) -> tuple[str, ...]:
    """What a format stands for; an unknown one is JSON."""
    return FORMATS.get((wanted or "").strip().lower(), ("json",))


def publish(path: str, data: bytes) -> str:
    """Writes beside the path and renames."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
    return path


def write_files(df: DataFrame, folder: str, name: str, data: str, encode: Callable[[object], bytes] = lambda x: x.encode("utf-8")) -> DataFrame:
    """path, bytes of one file for each row: its name and its data through ``encode``. Lazy: an action writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sizes = [], []
            for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = encode(x)
                paths.append(publish(os.path.join(folder, n), raw))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return df.select(name, data).mapInArrow(run, "path string, bytes bigint")


def csv_bytes(rows: list[list[str | None]]) -> bytes:
    """Rows as CSV: byte order mark, CRLF, quotes where needed."""
    out = io.StringIO()
    out.write(BOM)
    csv.writer(out).writerows(["" if c is None else c for c in r] for r in rows)
    return out.getvalue().encode("utf-8")


def column_name(n: int) -> str:
    """1 to A, 27 to AA."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx_bytes(sheets: list[tuple[str, list[list[str]], list[tuple[int, int, int, int]]]]) -> bytes:
    """(name, rows, merges) each as a sheet: every cell text, the first row frozen."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s[0][:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="49" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for i, (_, rows, merges) in zip(n, sheets, strict=True):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{column_name(c)}{r}" s="1" t="inlineStr"><is><t xml:space="preserve">{escape(_plain(v))}</t></is></c>' for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
            joined = f'<mergeCells count="{len(merges)}">' + "".join(f'<mergeCell ref="{column_name(b)}{a}:{column_name(d)}{c}"/>' for a, b, c, d in merges) + "</mergeCells>" if merges else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{body}</sheetData>{joined}</worksheet>')
    return out.getvalue()


def _plain(v: str | None) -> str:
    """Text that XML can hold."""
    return "".join(c for c in v or "" if c in "\t\n\r" or ord(c) >= 32)


def write_csv_tables(df: DataFrame, folder: str) -> DataFrame:
    """One CSV a row of (file_name, rows)."""
    return write_files(df, folder, "file_name", "rows", csv_bytes)


def write_workbooks(df: DataFrame, folder: str) -> DataFrame:
    """One XLSX a row of (file_name, sheets: array of name, rows, merges)."""

    def encode(sheets: list[dict]) -> bytes:
        return xlsx_bytes([(s["name"], s["rows"], [(m["r1"], m["c1"], m["r2"], m["c2"]) for m in s["merges"] or []]) for s in sheets])

    return write_files(df, folder, "file_name", "sheets", encode)
