"""Conversion runs: failures by document, names, upright pages, schedules, what is kept, artefacts, jobs, the verified form."""

import csv
import json
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import grids, layout
from quire.plans import convert as C
from quire.plans import jobs, made, verified
from quire.sources import pdf as P
from quire.streaming import resume

PROSE = "prose of more than forty characters stands in this line"
IMAGE = b"q 100 0 0 100 40 400 cm BI /W 1 /H 1 /BPC 8 /CS /G ID \x80 EI Q "


def put(folder, name, data):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder / name)


def doc(folder, name):
    return json.load(open(folder / name, encoding="utf-8"))


def test_pages_are_checked_by_document(spark, tmp_path, make_pdf, text_at):
    put(tmp_path, "in/one.pdf", make_pdf(text_at((40, 700, PROSE))))
    put(tmp_path, "in/two.pdf", make_pdf(text_at((40, 700, "first")), text_at((40, 700, PROSE))))
    paths, failed = C.convert(spark, [str(tmp_path / "in/*.pdf"), str(tmp_path / "none*.pdf")], str(tmp_path / "out"), pages="2")
    assert [re.sub(".*/", "", p) for p in paths] == ["two_rag.json"]
    assert sorted(f[0].rsplit("/", 1)[-1] for f in failed) == ["none*.pdf", "one.pdf"] and any(C.OUT_OF_RANGE in f[1] for f in failed)


def test_files_of_one_name_stay_apart(spark, tmp_path, make_pdf, text_at):
    for k in "ab":
        put(tmp_path, f"{k}/x.pdf", make_pdf(text_at((40, 700, f"{PROSE} {k}"))))
    put(tmp_path, "a/y.pdf", make_pdf(text_at((40, 700, f"{PROSE} a"))))  # a copy under another name
    paths, failed = C.convert(spark, [str(tmp_path / "*/*.pdf"), str(tmp_path / "a/*.pdf")], str(tmp_path / "out"))
    assert failed == [] and len(paths) == 3 and sum("x_" in p for p in paths) == 2
    assert sorted(json.load(open(p, encoding="utf-8"))["sections"][0]["raw_text"][-1] for p in paths) == ["a", "a", "b"]


def test_turned_page_reads_upright(spark, tmp_path, make_pdf):
    """Text drawn upwards is turned before lines are put in order."""
    lines = ["the first line of a turned page", "the second line of a turned page"]
    content = b"\n".join(f"BT /F1 10 Tf 0 1 -1 0 {100 + 20 * k} 50 Tm ({t}) Tj ET".encode() for k, t in enumerate(lines))
    C.convert(spark, [put(tmp_path, "t.pdf", make_pdf(content))], str(tmp_path / "out"))
    page = doc(tmp_path / "out", "t_rag.json")["sections"][0]
    assert page["orientation_correction"] == 90 and page["page_size"] == [792.0, 612.0]
    assert [x.strip() for x in page["layout_text"].split("\n")] == lines
    assert page["reading_order"] == layout.READING_ORDER


def test_ten_characters_turn_no_page(spark):
    char = lambda i: ("d", 1, 2 + i, 1, "char", 0.0, 0.0, 1.0, 1.0, "x", 0.0, 1.0)
    line = lambda n: ("d", 1, 1, None, "line", 0.0, 0.0, 1.0, 1.0, "x" * n, 0.0, 1.0)
    vote = lambda n: layout.orientation(spark.createDataFrame([line(n), *map(char, range(n))], P.SCHEMA)).collect()[0].correction
    assert (vote(10), vote(19), vote(20)) == (0, 0, 90)


@pytest.mark.parametrize("q", [90, 180, 270])
def test_upright_turns_back(spark, q):
    """Four turns by a quarter are none, and boxes keep their sides' order."""
    rows = [("d", 1, 1, None, "page", 0.0, 0.0, 600.0, 800.0, None, None, None), ("d", 1, 2, 1, "line", 10.0, 20.0, 50.0, 32.0, "x" * 30, 0.0, 1.0), ("e", 1, 1, None, "line", 1.0, 2.0, 3.0, 4.0, "no page", 0.0, 1.0)]
    df = spark.createDataFrame(rows, P.SCHEMA)
    turns = spark.createDataFrame([("d", 1, q), ("e", 1, q)], "doc_id string, page_no int, correction int")
    once = layout.upright(df, turns)
    line = once.where("doc_id = 'd' and obj_id = 2").collect()[0]
    assert line.x0 < line.x1 and line.y0 < line.y1 and once.where("doc_id = 'e'").collect()[0].x0 == 1.0
    for _ in range({90: 3, 180: 1, 270: 3}[q]):
        once = layout.upright(once, turns)
    assert sorted(tuple(r) for r in once.collect() if r.doc_id == "d") == sorted(rows[:2])


def schedule(make_pdf, text_at):
    head = text_at((200, 700, "Harmonized Tariff"), (200, 680, "Schedule of goods"), (260, 500, "CHAPTER 7"))
    rules = b" ".join(f"{x} 100 m {x} 700 l S".encode() for x in made.EDGES)
    body = text_at((160, 660, "Article Description"), (395, 640, "General"), (42, 600, "0101"), (155, 601, "Horses"), (392, 600, "Free"))
    return make_pdf(head.replace(b"Tariff)", b"Tariff Schedule)"), rules + b" " + body)


def test_schedule_is_told_by_its_first_pages(spark, tmp_path, make_pdf, text_at):
    """A page asked for alone still is one of a schedule: chapter, labelled rows, notice."""
    C.convert(spark, [put(tmp_path, "s.pdf", schedule(make_pdf, text_at))], str(tmp_path / "out"), pages="2", doc_type="chapter")
    d = doc(tmp_path / "out", "s_rag.json")
    page = d["sections"][0]
    assert d["document_type"] == "hts" and d["title"].startswith("Harmonized Tariff Schedule of the United") and page["source_page"] == 2 and page["chapter"] == 7 and page["chapter_title"] == "Chapter 7"
    assert page["table_rows"] == [{"Heading/Subheading": "0101", "Statistical suffix": "", "Article description": "Horses", "Unit of quantity": "", "General duty": "Free", "Special duty": "", "Column 2 duty": ""}]
    assert page["warnings"][-1].startswith("Table rows are physical lines") and page["table_row_semantics"].startswith("Physical lines")


def test_what_is_kept_isnt_made_again(spark, tmp_path, make_pdf, text_at):
    path = put(tmp_path, "in/a.pdf", make_pdf(text_at((40, 700, PROSE))))
    put(tmp_path, "in/b.pdf", make_pdf(text_at((40, 700, PROSE + " b"))))
    calls = tmp_path / "calls"
    calls.mkdir()

    def decoder(name, data, pages=None):
        (calls / f"{name}-{len(list(calls.iterdir()))}").touch()
        return P.decode(name, data, pages)

    run = lambda: C.convert(spark, [str(tmp_path / "in/*.pdf")], str(tmp_path / "out"), work=str(tmp_path / "work"), decoder=decoder)
    run()
    assert len(list(calls.iterdir())) == 2
    run()
    assert len(list(calls.iterdir())) == 2
    put(tmp_path, "in/a.pdf", make_pdf(text_at((40, 700, PROSE + " anew"))))
    run()
    assert len(list(calls.iterdir())) == 3 and doc(tmp_path / "out", "a_rag.json")["sections"][0]["raw_text"].endswith("anew")
    assert path
    # a table that can't be read counts as missing
    for f in (tmp_path / "work").rglob("*.parquet"):
        f.write_bytes(b"broken")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    run()
    assert len(list(calls.iterdir())) == 5 and doc(tmp_path / "out", "b_rag.json")["sections"][0]["raw_text"].endswith("b")


class Draws:
    def crop(self, content, page_no, turn, box):
        if page_no == 2:
            raise RuntimeError("no ink")
        return content[:4] + repr(box).encode()


class Reads:
    def predict(self, rows):
        return [(rows[0]["image"].decode(), '{"n": 1}')]


def test_regions_reach_the_recognizer_as_images(spark, tmp_path, make_pdf):
    path = put(tmp_path, "i.pdf", make_pdf(IMAGE, IMAGE))
    paths, _ = C.convert(spark, [path], str(tmp_path / "out"), "both", engine="ocr", make_backend=Reads, store=str(tmp_path / "store"), make_renderer=Draws, workers=2)
    first, second = doc(tmp_path / "out", "i_rag.json")["sections"]
    assert first["image_ocr"][0]["markdown"].startswith("%PDF(166, 1") and first["image_ocr"][0]["accuracy_verified"] is False
    assert "image_ocr" not in second and second["ocr_flags"][0]["detail"] == "Rendering failed: no ink"
    folder = tmp_path / "out/i_ocr/page-1-region-1"
    assert (folder / "content.md").read_text().startswith("%PDF") and doc(folder, "ocr_result.json") == {"n": 1} and (folder / "region.png").read_bytes().startswith(b"%PDF")
    flags = doc(tmp_path / "out", "i_recovery_flags.json")
    assert [f["status"] for f in flags] == ["converted", "unresolved"] and flags[0]["accuracy_verified"] is False
    report_paths, _ = C.convert(spark, [path], str(tmp_path / "out"), "csv", engine="ocr", make_backend=Reads, store=str(tmp_path / "store"), make_renderer=Draws, name="Mine.csv")
    assert (tmp_path / "out/Mine_page-1-table-1.csv").exists() and len(report_paths) == 3
    report = doc(tmp_path / "out", "i_table_report.json")
    assert report["pages"][0]["ocr_flags"][0]["image_sequence"] == 1 and report["pages"][0]["ocr_flags"][0]["bbox"]
    assert any("unusually short" not in w and w.startswith("WARNING: page-1") for w in doc(tmp_path / "out", "i_validation.json"))


def test_domains(spark, tmp_path):
    for bad in ({"doc_type": "x"}, {"workers": 4}, {"fmt": "pdf"}, {"engine": "gpu"}):
        with pytest.raises(ValueError, match="must be one of"):
            C.convert(spark, ["x.pdf"], str(tmp_path), **bad)


def test_job_request_and_log(spark, tmp_path, make_pdf, text_at, monkeypatch):
    path = put(tmp_path, "j.pdf", make_pdf(text_at((40, 700, PROSE))))
    (tmp_path / "job.json").write_text(json.dumps({"files": [path], "out": str(tmp_path / "out"), "format": "md", "log": str(tmp_path / "logs/run.log"), "workers": None}, indent=2))
    assert C.main(["--request", str(tmp_path / "job.json"), "--format", "json"]) == 0
    assert (tmp_path / "out/j_rag.md").exists()
    said = []
    at = jobs.tail(str(tmp_path / "logs/run.log"), 0, said.append)
    assert any("Native pass: 1 pages" in x for x in said) and said[-1].startswith("Output written")
    log = jobs.Log(str(tmp_path / "logs/run.log"))
    with open(log.path, "a") as f:
        f.write("half")
    assert jobs.tail(log.path, at, said.append) == at and jobs.tail(str(tmp_path / "none"), 3, said.append) == 3
    more = []
    jobs.follow(log.path, lambda: True, more.append)
    assert more == said
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError, match="job request"):
        jobs.request(spark, str(tmp_path / "bad.json"))
    assert jobs.eta(2, 6, 3.0) == 6.0 and jobs.eta(0, 6, 3.0) == 0


def test_batch_that_runs_again_adds_nothing(spark, tmp_path, make_pdf, text_at):
    """A batch writes a folder of its own number: what a dead run left of it is replaced."""
    for k in "ab":
        put(tmp_path, f"in/{k}/x.pdf", make_pdf(text_at((40, 700, f"text {k}"))))
    src, out = str(tmp_path / "in/*"), str(tmp_path / "objects")
    resume.run_to_end(resume.convert_new(spark, src, out, str(tmp_path / "mark")))
    n = spark.read.parquet(out).count()
    assert spark.read.parquet(out).where("kind = 'line'").select("doc_id").distinct().count() == 2
    resume.run_to_end(resume.convert_new(spark, src, out, str(tmp_path / "other mark")))  # the same batch number again
    assert spark.read.parquet(out).count() == n


FORM = grids.Form(edges=4, right_edge=340.0, level_over=250.0, codes=(16.0, 45.0))


def form(text_at, *cells):
    rules = [f"{x} 300 m {x} 480 l S" for x in (40, 140, 240)] + [f"40 {y} m 340 {y} l S" for y in (300, 390, 480)]
    return " ".join(rules).encode() + b" " + text_at(*cells)


def test_verified_export(spark, tmp_path, make_pdf, text_at):
    good = form(text_at, (44, 420, "101"), (150, 420, "Ropes"), (250, 420, "x, y"), (44, 330, "102"), (150, 330, "Nets"))
    objects = lambda *pages: spark.createDataFrame(list(P.decode("in/f.pdf", make_pdf(*pages))), P.SCHEMA)
    paths = verified.export(objects(good, form(text_at, (44, 420, "7"), (150, 420, "One"))), str(tmp_path), FORM, ("A", "B", "C"))
    assert [re.sub(".*/", "", p) for p in paths] == ["f.csv", "page-001.csv", "page-002.csv", "validation.json"]
    rows = list(csv.reader(open(tmp_path / "f-csv/f.csv", encoding="utf-8-sig", newline="")))
    assert rows == [["Página PDF", "Fila en página", "A", "B", "C"], ["1", "1", "101", "Ropes", "x, y"], ["1", "2", "102", "Nets", ""], ["2", "1", "7", "One", ""]]
    report = doc(tmp_path / "f-csv", "validation.json")
    assert report["total_rows"] == 3 and report["pages"][0] == {"page": 1, "rows": 2, "item_codes": 2, "characters": 19}
    with pytest.raises(ValueError, match="edges"):
        verified.export(objects(good), str(tmp_path / "n"), grids.Form())
    lost = objects(good).where("not (kind = 'char' and text = '2')")
    with pytest.raises(ValueError, match="item codes"):
        verified.export(lost, str(tmp_path / "n"), FORM)
    assert not (tmp_path / "n").exists()
    assert grids.verified(objects(text_at((40, 700, "x"))), FORM).collect()[0].error == "no column rules"
    assert grids.verified(spark.createDataFrame([], P.SCHEMA)).count() == 0


def test_means_of_chains():
    assert grids.means([]).tolist() == [] and grids.means([3.0, 1.0, 1.5, 2.4, 9.0]).tolist() == [1.975, 9.0]


def test_objects_once_within_a_page(spark):
    df = spark.createDataFrame([("d", [(2, "b"), (1, "a"), (2, "b"), (2, "c")])], "k string, l array<struct<obj_id:int,t:string>>")
    assert [tuple(x) for x in df.select(layout.once(F.col("l")).alias("l")).collect()[0].l] == [(1, "a"), (2, "b")]
