import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("BENCH_CPUS", "4")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quire.session import session

    return session("quire-tests", master="local[4]", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


def pdf(*contents: bytes, box: str = "0 0 612 792", deflate: bool = False) -> bytes:
    """A small file: a page for each content stream."""
    import zlib

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    objects.append(font)
    for c in contents:
        data = zlib.compress(c) if deflate else c
        n = len(objects) + 1
        kids.append(f"{n} 0 R")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [{box}] /Contents {n + 1} 0 R /Resources << /Font << /F1 3 0 R >> >> >>".encode())
        objects.append(f"<< /Length {len(data)}{' /Filter /FlateDecode' if deflate else ''} >>\nstream\n".encode() + data + b"\nendstream")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out = b"%PDF-1.4\n"
    for i, o in enumerate(objects, 1):
        out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def said(*items: tuple[float, float, str], size: int = 10) -> bytes:
    return b"\n".join(f"BT /F1 {size} Tf {x} {y} Td ({t}) Tj ET".encode() for x, y, t in items)


@pytest.fixture
def make_pdf():
    return pdf


@pytest.fixture
def text_at():
    return said
