"""Line predicates and names."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X


def on(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_clean_keeps_all_but_blank_lines(spark):
    text = "a\r\nb\n\n\n\nc\f(cid:42)\n12\n12"
    assert on(spark, X.clean, text, "   x \n", None, "") == ["a\nb\n\nc\n\n(cid:42)\n12\n12", "x", None, ""]
    once = on(spark, X.clean, text)[0]
    assert on(spark, X.clean, once) == [once]


def test_splitlines_as_python(spark):
    values = ["a\nb", "a\n", "", "\n", "a\r\nb\rc\x0bd\x85e f", "a\n\n"]
    assert on(spark, X.splitlines, *values) == [v.splitlines() for v in values]


def test_headings(spark):
    yes = ["Scope of the Rules", "GENERAL NOTES", "Annex 3", "X-Ray Tables"]
    no = ["Scope of the rules", "A sentence.", "Limits:", "ab", "Page 12", "12-3", "lower case", "", None, "!DCA Notice", "x" * 121]
    assert on(spark, X.is_heading, *yes) == [True] * len(yes)
    assert not any(on(spark, X.is_heading, *no))


def test_kinds_of_lines(spark):
    assert on(spark, X.is_bullet, "- a", "• b", "3) c", "a. d", "-a", "plain") == [True] * 4 + [False] * 2
    assert on(spark, X.is_table_row, "a  b", "a\tb", "a b", "- a  b", "  ") == [True, True, False, False, False]
    assert on(spark, X.is_page_number, "3-4", "Page 12", "1234", "12345", "p. 4") == [True, True, True, False, False]
    assert on(spark, X.is_image_artifact, "image", "-----", "|_|_|_|", "text", "") == [True, True, True, False, False]


@pytest.mark.parametrize(("name", "number"), [("chapter_3.pdf", 3), ("ch3.pdf", 3), ("chapter3.pdf", 3), ("03.pdf", 3), ("2026HTSRev20.pdf", 0), ("2026_hts.pdf", 0), ("a/b/My Chapter 12 x.pdf", 12), ("1234.pdf", 0)])
def test_chapter_numbers(spark, name, number):
    assert on(spark, X.chapter_number, name) == [number]


def test_output_names(spark):
    df = spark.createDataFrame([("out.json", "x.pdf"), ("", "chapter_3.pdf"), ("", "x.pdf"), ("a.b", "x.pdf")], "n string, s string")
    assert [r[0] for r in df.select(X.output_base(F.col("n"), F.col("s"))).collect()] == ["out", "chapter_3_rag", "x_rag", "a.b"]


def test_page_lists(spark):
    assert on(spark, X.page_list, "1,3-5,3", " 2 ", "", None) == [[0, 2, 3, 4], [1], None, None]
    assert on(spark, X.page_list_valid, "1,3-5", "", "0", "5-1", "1-2-3", "abc", "1,,2") == [True, True, False, False, False, False, False]
    for bad in ("0", "5-1", "1-2-3", "abc"):
        with pytest.raises(Exception, match="pages must be numbers"):
            on(spark, X.page_list, bad)


def test_fences_and_quality(spark):
    assert on(spark, X.fence, "x", "```", "a ````` b") == ["```", "````", "``````"]
    df = spark.createDataFrame([('{"res": {"overall_ocr_res": {"rec_scores": [0.99, 0.82]}}}', "<TABLE>" + "a" * 28 + " $x ^{$ $"), ('{"overall_ocr_res": {"rec_scores": [0.95]}}', "fine"), ("broken", None), (None, "$")], "raw string, m string")
    sizes = [len(r[0]) for r in df.select(X.quality_warnings(F.col("raw"), F.col("m"))).collect()]
    assert sizes == [4, 0, 0, 1]
