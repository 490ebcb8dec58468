"""PDF files to layout objects: files with their digests, a decoder for plain files, a Spark data source.

``files`` lists what patterns match through Hadoop's file systems, with path, digest and bytes; a
pattern that matches nothing is kept, as a failure. ``layout_objects`` decodes them, by the
decoder here or any other (a function of bytes to rows of ``page_objects``' form), a bounded
number of rows at a time.

The decoder here reads what simple producers write: objects, Flate streams, page trees with
inherited boxes, text (BT..ET with Td, TD, Tm, T*, Tj, TJ, ' and "), paths (re, m, l, h, S, f,
B), inline and XObject images, cm, q and Q. Encrypted files, object streams and composite fonts
are errors of their document, given as a row of kind ``error``. Where another decoder exists,
its rows of the same columns serve all operators as well.
"""

from __future__ import annotations

import glob
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, page_no int, obj_id int, parent_id int, kind string, x0 double, y0 double, x1 double, y1 double, text string, m_a double, m_b double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Mean advance of a character in ems, where a font gives no widths.
ADVANCE = 0.5

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%{}]*|[^\s<>\[\]()/%{}]+", re.S)


class Ref(int):
    """A reference to an object."""


class Name(str):
    """A name."""


def _text(raw: bytes) -> str:
    if raw.startswith(b"<"):
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode() + ("0" if len(re.sub(rb"\s", b"", raw[1:-1])) % 2 else ""))
    else:
        escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

        def one(m: re.Match) -> bytes:
            s = m[1]
            return bytes([int(s, 8) & 255]) if s[:1].isdigit() else b"" if s in (b"\n", b"\r", b"\r\n") else escapes.get(s, s)

        data = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def _parse(data: bytes) -> list:
    """Values of a piece of syntax; operators come as bytes."""
    root: list = []
    stack = [root]
    for m in _TOKEN.finditer(data):
        t = m.group()
        top = stack[-1]
        if t[:1] == b"%":
            continue
        if t in (b"[", b"<<"):
            stack.append([])
        elif t == b"]":
            top = stack.pop()
            stack[-1].append(top)
        elif t == b">>":
            items = stack.pop()
            stack[-1].append({k: v for k, v in zip(items[::2], items[1::2], strict=False)})
        elif t[:1] == b"/":
            top.append(Name(t[1:].decode("latin-1")))
        elif t[:1] in b"(<":
            top.append(_text(t))
        elif t == b"R" and len(top) >= 2:
            top.pop()
            top.append(Ref(top.pop()))
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            top.append(float(t) if b"." in t else int(t))
        else:
            top.append({b"true": True, b"false": False, b"null": None}.get(t, t))
    return root


class Pdf:
    """Objects of a file and its pages in order."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", data, re.S):
            body = m[2]
            cut = re.search(rb"stream\r?\n", body)
            head = body[: cut.start()] if cut else body
            value = (_parse(head) or [None])[0]
            stream = None
            if cut and isinstance(value, dict):
                size = self.value(value.get("Length"))
                rest = body[cut.end() :]
                stream = rest[:size] if isinstance(size, int) and size <= len(rest) else re.sub(rb"\r?\nendstream\s*$", b"", rest)
                stream = re.sub(rb"\r?\n?endstream.*$", b"", stream, flags=re.S)
            self.objects[int(m[1])] = (value, stream)
        if b"/Encrypt" in data:
            raise ValueError("the file is encrypted")
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        self.pages = list(self._tree(self.value(roots[-1].get("Pages")), {})) if roots else []

    def value(self, v: object) -> object:
        return self.objects.get(int(v), (None, None))[0] if isinstance(v, Ref) else v

    def _tree(self, node: object, given: dict) -> Iterator[dict]:
        if not isinstance(node, dict):
            return
        own = given | {k: node[k] for k in ("MediaBox", "Rotate", "Resources") if k in node}
        if node.get("Type") == "Page" or "Kids" not in node:
            yield own | node
        else:
            for k in self.value(node["Kids"]) or []:
                yield from self._tree(self.value(k), own)

    def content(self, page: dict) -> bytes:
        refs = page.get("Contents")
        refs = refs if isinstance(refs, list) else self.value(refs) if isinstance(self.value(refs), list) else [refs]
        return b"\n".join(self._stream(r) for r in refs if isinstance(r, Ref))

    def _stream(self, ref: Ref) -> bytes:
        value, data = self.objects.get(int(ref), (None, None))
        if data is None:
            return b""
        filters = self.value(value.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "FlateDecode":
                data = zlib.decompress(data)
            elif f is not None:
                raise ValueError(f"filter {f}")
        return data


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _at(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def _box(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def page_objects(pdf: Pdf, page: dict) -> list[tuple]:
    """(kind, parent, x0, y0, x1, y1, text, m_a, m_b) of a page; the first is the page itself, parents are places in the list from 1."""
    media = [float(v) for v in pdf.value(page.get("MediaBox")) or (0, 0, 612, 792)]
    turn = int(pdf.value(page.get("Rotate")) or 0) % 360
    w, h = media[2] - media[0], media[3] - media[1]
    base = {0: (1, 0, 0, 1, -media[0], -media[1]), 90: (0, -1, 1, 0, -media[1], media[2]), 180: (-1, 0, 0, -1, media[2], media[3]), 270: (0, 1, -1, 0, media[3], -media[0])}[turn]
    out: list[tuple] = [("page", None, 0.0, 0.0, *((h, w) if turn in (90, 270) else (w, h)), None, None, None)]
    resources = pdf.value(page.get("Resources")) or {}
    xobjects = pdf.value(resources.get("XObject")) or {}
    ctm, saved, path, args = base, [], [], []
    tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    size, lead = 1.0, 0.0
    data = pdf.content(page)
    # inline images hold bytes that are no syntax
    data = re.sub(rb"\bID[ \r\n].*?[\s]EI\b", b" EI ", data, flags=re.S)

    def show(s: str) -> None:
        nonlocal tm
        m = _times(tm, ctm)
        x = 0.0
        chars = []
        for c in s:
            chars.append(("char", *_box([_at(m, x, 0), _at(m, x + ADVANCE * size, size)]), c))
            x += ADVANCE * size
        if chars:
            out.append(("line", 1, *_box([_at(m, 0, 0), _at(m, x, size)]), s, m[0], m[1]))
            parent = len(out)
            out.extend((k, parent, a, b, c, d, t, m[0], m[1]) for k, a, b, c, d, t in chars)
        tm = _times((1, 0, 0, 1, x, 0), tm)

    for t in _parse(data):
        if not isinstance(t, bytes):
            args.append(t)
            continue
        op = t.decode("latin-1")
        if op == "q":
            saved.append(ctm)
        elif op == "Q" and saved:
            ctm = saved.pop()
        elif op == "cm":
            ctm = _times(tuple(args[-6:]), ctm)
        elif op == "BT":
            tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        elif op == "Tf":
            size = float(args[-1])
        elif op == "TL":
            lead = float(args[-1])
        elif op in ("Td", "TD"):
            lead = -float(args[-1]) if op == "TD" else lead
            tm = line = _times((1, 0, 0, 1, args[-2], args[-1]), line)
        elif op == "Tm":
            tm = line = tuple(map(float, args[-6:]))
        elif op in ("T*", "'", '"'):
            tm = line = _times((1, 0, 0, 1, 0, -lead), line)
            if op != "T*" and args:
                show(args[-1])
        elif op == "Tj" and args:
            show(args[-1])
        elif op == "TJ" and args:
            show("".join(x if isinstance(x, str) else " " if x < -200 else "" for x in args[-1]))
        elif op == "re":
            x, y, rw, rh = args[-4:]
            path.append(("rect", [_at(ctm, x, y), _at(ctm, x + rw, y + rh)]))
        elif op == "m":
            path.append(("rule", [_at(ctm, *args[-2:])]))
        elif op == "l" and path:
            path[-1][1].append(_at(ctm, *args[-2:]))
        elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
            out.extend((kind, 1, *_box(points), None, None, None) for kind, points in path if len(points) > 1)
            path = []
        elif op == "n":
            path = []
        elif op == "EI" or (op == "Do" and isinstance(pdf.value(xobjects.get(args[-1] if args else "")), dict) and pdf.value(xobjects[args[-1]]).get("Subtype") == "Image"):
            out.append(("image", 1, *_box([_at(ctm, 0, 0), _at(ctm, 1, 1)]), None, None, None))
        args = []
    return out


def decode(name: str, data: bytes, pages: set[int] | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA of a file, or of its pages (zero-based) alone; one row of kind error if it can't be read."""
    try:
        pdf = Pdf(data)
        for n, page in enumerate(pdf.pages):
            if pages is None or n in pages:
                for k, (kind, parent, *rest) in enumerate(page_objects(pdf, page), 1):
                    x0, y0, x1, y1, text, a, b = rest
                    yield name, n + 1, k, parent, kind, float(x0), float(y0), float(x1), float(y1), text, a if a is None else float(a), b if b is None else float(b)
    except Exception as e:
        yield name, None, None, None, "error", None, None, None, None, f"{type(e).__name__}: {e}", None, None


def files(spark: SparkSession, patterns: list[str]) -> tuple[DataFrame, list[str]]:
    """path, digest, content of the files that the patterns match, each file once, and the patterns that match nothing."""
    found, none = [], []
    jvm = spark._jvm
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        hits = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        (found if hits is not None and len(hits) else none).append(p)
    if not found:
        return spark.createDataFrame([], "path string, digest string, content binary"), none
    read = spark.read.format("binaryFile").load(found).select("path", F.sha2("content", 256).alias("digest"), "content")
    return read if len(found) == 1 else read.dropDuplicates(["path"]), none


#: Rows of an Arrow batch of decoded objects.
BATCH = 20_000


def layout_objects(files: DataFrame, pages: list[int] | None = None, decoder: Callable[..., Iterator[tuple]] = decode) -> DataFrame:
    """Rows of SCHEMA from binary files (path, content), decoded in Arrow batches; doc_id is the path."""
    wanted = None if pages is None else set(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = decoder(path, data, wanted)
                while some := list(islice(rows, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in enumerate(_TYPES)], names=COLUMNS)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64()]


def digests(files: DataFrame) -> DataFrame:
    """path, digest of binary files."""
    return files.select("path", F.sha2("content", 256).alias("digest"))


class _File(InputPartition):
    def __init__(self, path: str, pages: tuple[int, ...] | None):
        self.path, self.pages = path, pages


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        listed = options.get("pages", "").strip()
        self.pages = tuple(parse_pages(listed)) if listed else None

    def partitions(self) -> list[InputPartition]:
        """A partition a file; a pattern that matches nothing stays a path and fails as a row."""
        return [_File(p, self.pages) for p in sorted(glob.glob(self.path)) or [self.path]]

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            with open(partition.path, "rb") as f:
                data = f.read()
        except OSError as e:
            data = None
            yield partition.path, None, None, None, "error", None, None, None, None, f"{type(e).__name__}: {e}", None, None
        if data is not None:
            yield from decode(partition.path, data, None if partition.pages is None else set(partition.pages))


class PdfSource(DataSource):
    """``spark.read.format("pdf_layout").option("pages", "1-3").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "pdf_layout"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)


def parse_pages(spec: str) -> list[int]:
    """'1,3-5,3' to [0, 2, 3, 4]."""
    out: set[int] = set()
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not m or int(m[1]) < 1 or int(m[2] or m[1]) < int(m[1]):
            raise ValueError("pages must be numbers from 1 or ascending ranges, such as 1-5,10")
        out |= set(range(int(m[1]) - 1, int(m[2] or m[1])))
    return sorted(out)
