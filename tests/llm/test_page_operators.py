"""Markup, lines of a source, scanned text against brute force and made cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quire.llm import boilerplate, common, markup, queries, scan_noise, sql
from tests.compare import database, rows_of, sql_rows

# --- markup


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("# Head", {"heading"}), ("Head\n====", {"heading"}), ("== Head ==", {"heading"}), ("<h2 class='t'>Head</h2>", {"heading"}), ("\\section*{Head}", {"heading"}), ("<H3>cut", {"heading"}),
        ("* a\n* b", {"list"}), ("- [ ] a", {"list"}), ("<ul><li>a</li></ul>", {"list"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"list"}), ("<dt>a</dt><dd>b</dd>", {"list"}),
        ("```py\n# no heading\n- no list\n```", {"code"}), ("~~~\n$x = $y\n", {"code"}), ("<pre><code>a &lt; b\n</code></pre>", {"code"}), ("\\begin{verbatim}\n<table>\n\\end{verbatim}", {"code"}),
        ("$$x^{2}$$", {"formula"}), ("Here $a_{k}$ holds.", {"formula"}), ("The rate is $x^{2} for looms.", {"formula"}), ("\\[m = \\rho V\\]", {"formula"}), ("<math><mi>x</mi></math>", {"formula"}), ("\\begin{align*}\na &= b \\\\\n\\end{align*}", {"formula"}), ('<p class="math">\\(x\\)</p>', {"formula", "inline"}),
        ("| a | b |\n|---|---|\n| c | d |", {"table"}), ("a | b\n---|---\nc | d", {"table"}), ("{|\n|-\n| a || b\n|}", {"table"}), ("<table><tr><td>a</td></tr></table>", {"table"}), ("\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}", {"table"}), ("<html><body><table><tr><td>a</table></body></html>", {"table", "inline"}),
        ("<table>\n<tr><td>a</td></tr>\n\n<p>b</p>\n\n<table>\n<tr><td>c</td></tr>\n</table>", {"table", "inline"}), ("<table>\n<tr><td>a</td></tr>\n\n<h1>b</h1>\n\n* c\n\n<table><tr><td>d</td></tr></table>", {"table", "heading", "list"}), ("<table>\n<tr><td>a</td></tr>\n\n<tr><td>b</td></tr>\n</table>", {"table"}), ("{|\n| a || b\n\n''c''\n\n{|\n| d\n|}", {"table", "inline"}),
        ("a **b** c", {"inline"}), ("<p>a</p>", {"inline"}), ("a&nbsp;b", {"inline"}), ("<!-- x -->", {"inline"}), ("[a](b.md)", {"inline"}), ("[[a|b]]", {"inline"}), ("''a''", {"inline"}), ("\\emph{a}", {"inline"}), ("a~b\\\\", {"inline"}), ("<font size=2>a", {"inline"}), ("`a_1`", {"inline"}), ("# A **b**", {"heading", "inline"}),
        ("(a) lettered note", set()), ("- 12 -", set()), ("US$ 40 to US$ 60", set()), ("C:\\lists\\8", set()), ("plan_v2_final #4 <0.5 a & b Free*", set()), ("[OCR PENDING: page-1-region-1 — image content requires review]", set()), ("a | b | c", set()), ("-----", set()), ("[1] |x| [sic]", set()), ("", set()), ("   ", set()), ("1. Numbered", set()), ("1. One\n2. Two", {"list"}), ("3) c\n4) **d**", {"list", "inline"}), ("14. M\u00e4rz\n36) or", set()), ("1. One\n\n2. Two", set()), ("$" + "x + " * 200 + "y^{2}$", {"formula"}), ("= " + "Long " * 100 + "=", set()), ("== " + "Long " * 100 + "==", {"heading"}),
    ],
)
def test_kinds_of_markup(text, kinds):
    assert markup.kinds(markup.parse(text)) == kinds


def test_quick_check_misses_no_mark(spark, data):
    rows = markup.fields(spark.read.parquet(f"{data}/sections.parquet")).where(~markup.marked(markup.F.col("text"))).select("text").collect()
    assert rows and all(not markup.kinds(markup.parse(r.text)) for r in rows)


def test_clean_text_keeps_structure():
    text = "<h2>Rules &amp; terms</h2>\n\n* one\n* **two**\n\n```\na < b\n```\n\n<table><tr><td>x</td><td>y</td></tr></table>\n\n$$m = \\rho V$$\n\nPlain [link](u) ''text''<br>here"
    out = "\n".join(markup.render(n) for n in markup.parse(text))
    assert out == "## Rules & terms\n- one\n- two\n```\na < b\n```\n| x | y |\n$$ m = \\rho V $$\nPlain link text\nhere"


def test_found_markup_in_spark(spark):
    schema = "section_key bigint, doc_id bigint, content string, ocr_markdown string, image_ocr array<struct<region:int,markdown:string>>, loaded_at timestamp, kind string"
    rows = [(1, 1, "# a", None, [(3, "**b**"), None, (4, None)], None, "clash"), (1, 1, "# a", None, [(3, "**b**"), None, (4, None)], None, "clash"), (2, 1, None, "", None, None, None), (3, 1, "plain", "<p>x</p>", [], None, None)]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in markup.found_kinds(df).collect()} == {(1, "content", 0, "heading"), (1, "image_markdown", 3, "inline"), (3, "ocr_markdown", 0, "inline")}
    assert markup.found_kinds(df.where("false")).count() == 0


def test_style_tree_drops_fixed_branches(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    rows = [(k, k, f"# {word()}\n\nShare this page with friends\n\n{word()} {word()} {word()}", None, None, None) for k in range(40)]
    df = spark.createDataFrame(rows, "section_key bigint, doc_id bigint, content string, ocr_markdown string, image_ocr array<struct<region:int,markdown:string>>, loaded_at timestamp")
    docs = spark.createDataFrame([(k, "s") for k in range(40)], "doc_id bigint, source string")
    got = markup.clean_text(df, docs).collect()
    assert len(got) == 40 and all(r.n_removed == 1 and "Share" not in r.clean and r.clean.startswith("# ") for r in got)


def test_style_tree_keeps_real_text(spark):
    """Lines that differ in figures, what few of many pages share, and other kinds of a removed text stay."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    figures = lambda k: f"Heading {k}.{k + 7} takes {k} %"
    rows = [(k, k, f"{word()} {word()}\n\n{figures(k)}\n\nShare this page\n\n{'On some pages' if k % 12 == 0 else word()}\n\n{'# Share this page' if k == 3 else word()}", None, None, None) for k in range(600)]
    df = spark.createDataFrame(rows, "section_key bigint, doc_id bigint, content string, ocr_markdown string, image_ocr array<struct<region:int,markdown:string>>, loaded_at timestamp")
    docs = spark.createDataFrame([(k, "s") for k in range(600)], "doc_id bigint, source string")
    got = {r.section_key: r for r in markup.clean_text(df, docs).collect()}
    assert all(figures(k) in r.clean and "\nShare" not in r.clean and r.n_removed == 1 for k, r in got.items())
    assert all("On some pages" in got[k].clean for k in range(0, 600, 12)) and "# Share this page" in got[3].clean


STYLE = "section_key bigint, doc_id bigint, content string, ocr_markdown string, image_ocr array<struct<region:int,markdown:string>>, loaded_at timestamp"


def test_style_tree_keeps_what_differs_in_figures_and_signs(spark):
    """Formulas, code and prices of one form on every page stay; a notice, a repeated list and a named footer go as branches."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    def page(k):
        own = f"$$x + {k} = y$$\n\n```\nreturn {k}\n```\n\nPrice list {k}: {k * 3} EUR\n\n{word()} {word()}"
        menu = "* Home\n* Contact us\n* Imprint"
        foot = f'<div class="footer">\nAll rights reserved{" here" if k == 5 else ""}\n</div>'
        return f"{menu}\n\n{own}\n\n* {word()}\n* Contact us\n\n{foot}"
    df = spark.createDataFrame([(k, k, page(k), None, None, None) for k in range(40)], STYLE)
    got = {r.section_key: r for r in markup.clean_text(df, spark.createDataFrame([(k, "s") for k in range(40)], "doc_id bigint, source string")).collect()}
    for k, r in got.items():
        assert f"$$ x + {k} = y $$" in r.clean and f"return {k}\n" in r.clean and f"Price list {k}: {k * 3} EUR" in r.clean
        assert "Home" not in r.clean and "Imprint" not in r.clean and ("All rights" in r.clean) == (k == 5)
        assert r.n_removed == (5 if k != 5 else 4) and r.clean.count("\n\n\n") == 0


def test_dom_nests(spark):
    text = "<div class='a b'>\n# One\n\n* x\n** y\n\n## Two\n\ntext\n</div>\n\n| a | b |\n|---|---|\n| c | d |"
    root = markup.build(markup.parse(text))
    show = lambda b: (b.label.strip(), [show(c) for c in b.children])
    line = ("paragraph", [("line", [])])
    assert show(root) == ("page", [("div class=a b", [("section 1", [("heading atx", []), ("list bullet", [("item", []), ("item nested", [])]), ("section 2", [("heading atx", []), line])])]), ("table pipe", [("row", []), ("row", [])])])
    rows = markup.rows_of(text)
    for i, r in enumerate(rows):  # a branch ends behind its last node; only leaves have text
        assert i < r["end"] <= len(rows) and (r["clean"] is None) == (r["goes_on"] is not None)
    assert markup.rows_of("") == [] and len(markup.rows_of("<div>\n" * 5000)) == 5000


def test_style_tree_against_brute_force(spark):
    """Content importance and share of every node, counted plainly."""
    import math
    from collections import defaultdict

    rnd = random.Random(12)
    pool = ["share this", "* one\n* two", "# Head", "$$a$$", "| a | b |\n|---|---|\n| c | d |", "<p class=x>bye</p>"]
    texts = [(k, rnd.choice("stu"), "\n\n".join(rnd.choice(pool) if rnd.random() < 0.6 else "".join(rnd.choice("abcdef") for _ in range(6)) for _ in range(5))) for k in range(60)]
    df = spark.createDataFrame([(k, k, t, None, None, None) for k, _, t in texts], STYLE)
    nodes = markup.occurrences(markup.dom(df, spark.createDataFrame([(k, s) for k, s, _ in texts], "doc_id bigint, source string")))
    pages, on = defaultdict(set), defaultdict(set)
    for k, s, t in texts:
        pages[s].add(k)
        for r in markup.rows_of(t):
            if r["content"] is not None:
                on[s, r["path"], r["content"]].add(k)
    want = {key: (round(1 - math.log(len(v)) / math.log(len(pages[key[0]])), 9), round(len(v) / len(pages[key[0]]), 9)) for key, v in on.items()}
    got = {(r.source, r.path, r.content): (round(r.importance, 9), round(r.share, 9)) for r in markup.style_tree(nodes)[1].collect()}
    assert got == want


# --- lines of a source


def site(rows):
    """Brute force over (section_key, doc_id, source, text)."""
    docs = defaultdict(set)
    where = defaultdict(set)
    for _, d, s, t in rows:
        if s is None or d is None:
            continue
        docs[s].add(d)
        for x in (t or "").split("\n") if t is not None else []:
            if sum(c.isalpha() for c in x) >= 12:
                where[s, re.sub(r"[\d\s]", "", x.lower())].add(d)
    hot = {k for k, v in where.items() if len(v) >= 2 and len(v) * 5 >= len(docs[k[0]])}
    return {(k, i) for k, d, s, t in rows if s is not None and d is not None and t is not None for i, x in enumerate(t.split("\n"), 1) if sum(c.isalpha() for c in x) >= 12 and (s, re.sub(r"[\d\s]", "", x.lower())) in hot}


def test_site_lines(spark):
    rnd = random.Random(7)
    pool = [f"shared notice number {c * 5}" for c in "abcdefgh"] + ["short", "Shared  Notice number AAAAA 12"]
    rows, key = [], 0
    for d in range(60):
        s = rnd.choice(["a", "b", "b", "b", None])
        body = "\n".join(rnd.choice(pool) if rnd.random() < 0.3 else "".join(rnd.choice("uvwxyz") for _ in range(20)) for _ in range(6))
        for _ in range(rnd.randint(1, 3)):
            key += 1
            rows.append((key, d, s, body if rnd.random() < 0.9 else rnd.choice([None, ""])))
    rows += rows[:5] + [(1000, None, "a", "shared notice number aaaaa")]
    text = [r for r in rows if r[3] is not None]
    rows += [(2000 + k, 500 + k, "a", text[0][3]) for k in range(8)]  # one text under many ids
    df = spark.createDataFrame([(k, d, 1, t, None) for k, d, _, t in rows], "section_key bigint, doc_id bigint, source_page int, raw_text string, loaded_at timestamp")
    docs = spark.createDataFrame(list({(d, s) for _, d, s, _ in rows if d is not None}), "doc_id bigint, source string").selectExpr("*", "timestamp'2024-01-01' converted_at")
    got = {tuple(r) for r in boilerplate.found_lines(df, docs).collect()}
    assert got == site(rows)
    out = {r.section_key: r for r in boilerplate.without_lines(df, docs, by="documents").collect()}
    for k, _, _, t in rows:
        gone = {i for s, i in got if s == k}
        assert out[k].own_text == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in gone)) and out[k].n_site_lines == len(gone)
    assert boilerplate.found_lines(df.where("false"), docs).count() == 0 and boilerplate.found_lines(df, docs.where("false")).count() == 0


def test_copies_count_as_one_cluster(spark):
    """An article printed again, with other figures and page cuts, is no boilerplate; a notice on many clusters and dates is."""
    body = ["an article that was printed again", "its second line goes on {} times"]
    rows = [(k, k, 1, "\n".join(body).format(k) + "\nthe notice of the publisher", None) for k in range(5)]
    rows += [(20, 5, 1, body[0], None), (21, 5, 2, body[1].format(77) + "\nThe notice of the publisher", None)]
    rows += [(30 + k, 10 + k, 1, f"something else altogether {'abcd'[k] * 8}\nthe notice of  the publisher", None) for k in range(4)]
    df = spark.createDataFrame(rows, "section_key bigint, doc_id bigint, source_page int, raw_text string, loaded_at timestamp")
    docs = spark.createDataFrame([(d, "s") for d in sorted({r[1] for r in rows})], "doc_id bigint, source string").selectExpr("*", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id as int)) converted_at")
    counted = lambda **k: sorted((r.n_docs, r.n_clusters, r.n_dates) for r in boilerplate.site_lines(df, docs, **k).collect())
    assert counted() == [(10, 5, 5)]
    assert counted(by="documents") == [(6, 1, 1), (6, 1, 1), (10, 5, 5)]
    text = {r.section_key: r.own_text for r in boilerplate.without_lines(df, docs).collect()}
    assert text[0] == "an article that was printed again\nits second line goes on 0 times" and text[30] == "something else altogether aaaaaaaa"
    same_day = docs.selectExpr("doc_id", "source", "cast(null as timestamp) converted_at")
    assert boilerplate.site_lines(df, same_day).count() == 0 and boilerplate.site_lines(df, same_day, least_dates=1).count() == 1


def test_clusters_are_built_where_they_decide(spark, monkeypatch):
    """Copies count in a share of documents, so it needs no clusters; by clusters, or with a least number of clusters or dates, they change what is found."""
    texts = ["an article that was printed again\nthe notice of the publisher"] * 3 + [f"something else altogether {c * 8}\nthe notice of the publisher" for c in "abc"]
    rows = [(k, k, 1, t, None) for k, t in enumerate(texts)] + [(0, 0, 1, texts[0], None), (6, 6, 1, None, None), (7, None, 1, texts[0], None)]
    df = spark.createDataFrame(rows, "section_key bigint, doc_id bigint, source_page int, raw_text string, loaded_at timestamp")
    docs = spark.range(8).selectExpr("id doc_id", "'s' source", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id div 5 as int)) converted_at")
    real, built = boilerplate.clusters, []
    monkeypatch.setattr(boilerplate, "clusters", lambda *a, **k: built.append(1) or real(*a, **k))

    def found(**k):
        built.clear()
        return {tuple(r) for r in boilerplate.found_lines(df, docs, **k).collect()}, len(built)

    notice, article = {(k, 2) for k in range(6)}, {(k, 1) for k in range(3)}
    assert found() == (notice | article, 0) == found(least_clusters=1, least_dates=1)
    assert found(least_share=0.5) == (notice, 0) == found(least_documents=4)
    for limits in ({"least_clusters": 2}, {"least_dates": 2}, {"by": "clusters"}):
        assert found(**limits) == (notice, 1)
    for limits in ({}, {"least_share": 0.4}, {"least_share": 0.45}, {"least_documents": 3}, {"least_documents": 4}):
        lines = boilerplate.occurrences(df, docs)
        want = {tuple(r) for r in boilerplate.site_lines(df, docs, by="documents", lines=lines, **limits).select("source", "h1", "h2", "n_docs").collect()}
        assert {tuple(r) for r in boilerplate.document_lines(df, docs, lines, **limits).collect()} == want
    with pytest.raises(ValueError):
        boilerplate.found_lines(df, docs, by="dates")


def test_a_line_of_many_sources_costs_its_occurrences(spark):
    n = 1000
    df = spark.range(2 * n).selectExpr("id section_key", "id doc_id", "1 source_page", "'one notice of everyone' raw_text", "cast(null as timestamp) loaded_at")
    docs = spark.range(2 * n).selectExpr("id doc_id", "concat('s', id div 2) source", "timestamp'2024-01-01' converted_at")
    found = boilerplate.found_lines(df, docs)
    assert found.count() == 2 * n
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x and "h1" in x]
    assert joins and all("source" in x for x in joins)


# --- scanned text


def test_weighted_distance():
    assert scan_noise.distance("word", "word") == 0
    assert scan_noise.distance("hcading", "heading") == 0.5 and scan_noise.distance("amendrnent", "amendment") == 0.4 and scan_noise.distance("cat", "dog") == 3


def test_delete_keys_meet():
    for read, meant in (("hcading", "heading"), ("poicls", "poids"), ("arnendrnent", "amendment"), ("dassification", "classification"), ("authonsation", "authorisation"), ("8order", "border")):
        assert scan_noise._deletes(read, 0) & scan_noise._deletes(meant, 1), read
    for read, meant in (("hoading", "heading"), ("regstration", "registration"), ("haeding", "heading"), ("5e55i0n5", "sessions")):
        assert scan_noise._deletes(read, 0) & scan_noise._deletes(meant, 1), read
    assert not scan_noise._deletes("cat", 0) & scan_noise._deletes("dog", 1)


def test_parting():
    known = {"the": 900, "tariff": 100, "office": 100, "of": 900, "gaskets": 50, "and": 800, "theoffice": 3}
    assert scan_noise.part_word("thetariffoffice", known, 3000) == ["the", "tariff", "office"]
    assert scan_noise.part_word("theoffice", known, 3000) == ["the", "office"]
    assert scan_noise.part_word("unknown", known, 3000) == ["unknown"]


def corpus(spark):
    """Pages of a document with a running title, page numbers, cut and misread words, in a corpus of right ones."""
    rnd = random.Random(11)
    words = "the tariff office compares printed gaskets with heading numbers and examines every determination of crushed lanterns after separate registration".split()
    rows, key = [], 0
    for d in range(30):
        for p in range(1, 5):
            key += 1
            lines = [" ".join(rnd.choice(words) for _ in range(8)) for _ in range(12)]
            rows.append([key, d, p, lines])
    made = rows[:4]
    for _, _, p, lines in made:
        lines.insert(0, "Rules of the Harbour" if p != 3 else "Rules 0f the Harbour")
        lines.append(f"- {p} -")
    made[0][3][3] = "the hcading of every lantern"
    made[0][3][4] = "crushed lanterns after sepa-"
    made[0][3][5] = "rate registration"
    made[1][3][5] = "every determin5tion and theprintedgaskets"
    made[1][3][-2] = "numbers after regi-"
    made[2][3][1] = "stration of heading numbers"
    made[3][3][2] = "compares heat-"
    made[3][3][3] = "resistant gaskets"
    for r in rows[8:20]:
        r[3][2] = "heat-resistant gaskets"
    data = [(k, d, p, "\n".join(ls), None, None, None) for k, d, p, ls in rows]
    return spark.createDataFrame(data + data[:2], "section_key bigint, doc_id bigint, source_page int, raw_text string, ocr_markdown string, image_ocr array<struct<region:int,markdown:string>>, loaded_at timestamp"), made


def test_scan_noise_cases(spark):
    df, made = corpus(spark)
    lexicon = scan_noise.Lexicon(df)
    got = {(r.section_key, r.line_no, r.kind) for r in scan_noise.found_lines(df, lexicon).collect() if r.section_key <= 4}
    a, b, c, d = (m[0] for m in made)
    want = {(k, 1, "header") for k in (a, b, c, d)} | {(m[0], len(m[3]), "page_number") for m in made}
    want |= {(a, 4, "misread"), (a, 5, "hyphen"), (b, 6, "misread"), (b, len(made[1][3]) - 1, "hyphen")}
    assert got == want
    text = {r.section_key: r.text for r in scan_noise.repaired(df, lexicon).collect()}
    assert "the heading of every lantern" in text[a] and "separate registration" in text[a] and "Rules" not in text[a] and "- 1 -" not in text[a]
    assert "the printed gaskets" in text[b] and text[b].rstrip().endswith("registration")
    assert "stration" not in text[c].split()[:1] and "heat-resistant gaskets" in text[d].replace("heat- resistant", "heat-resistant")


PAGE = "section_key bigint, doc_id bigint, source_page int, raw_text string, ocr_markdown string, image_ocr array<struct<region:int,markdown:string>>, loaded_at timestamp"


def test_any_edit_within_a_word_is_repaired(spark):
    """Substituted, lost and swapped letters beside frequent words; figures that belong to a word, inflections and other words stay."""
    rnd = random.Random(3)
    words = "the tariff office compares printed gaskets with heading numbers and examines every determination of crushed lanterns after separate registration".split()
    lines = [" ".join(rnd.choice(words) for _ in range(9)) for _ in range(800)]
    odd = ["the hoading of every lanterns", "after regstration and the haeding numbers", "windows8 and section5 of the headings", "every he4ding of crushed gaskets", "office headlong compares"]
    pages = [(k, 1, k, "\n".join(lines[20 * k : 20 * k + 20] + odd[k : k + 1]), None, None, None) for k in range(40)]
    x = scan_noise.Lexicon(spark.createDataFrame(pages, PAGE))
    got = {r.word: r.repair for r in x.repairs().select("word", "repair").collect()}
    assert got == {"hoading": "heading", "regstration": "registration", "haeding": "heading", "he4ding": "heading"}
    text = {r.section_key: r.text for r in scan_noise.repaired(spark.createDataFrame(pages, PAGE), x).collect()}
    assert "after registration and the heading numbers" in text[1] and "windows8 and section5 of the headings" in text[2]


def test_running_titles_of_few_pages(spark):
    """A title on 8 of 40 pages, one longer than any line, none on two; ends of sentences are no titles."""
    rnd = random.Random(8)
    long = "Rules of the Harbour and of all its Basins " * 30

    def page(p):
        head = ["Of Ropes"] if 10 <= p < 18 else [long.strip()] if 20 <= p < 23 else ["On Two"] if p in (30, 31) else []
        return "\n".join([*head, *(" ".join("".join(rnd.choice("aegkmopstz") for _ in range(7)) for _ in range(5)) for _ in range(8)), *(["brought in."] if p % 9 == 0 else [])])

    df = spark.createDataFrame([(p, 1, p, page(p), None, None, None) for p in range(1, 41)], PAGE)
    got = {(r.section_key, r.line_no) for r in scan_noise.found_lines(df).where("kind = 'header'").collect()}
    assert got == {(p, 1) for p in (*range(10, 18), *range(20, 23))}


def test_words_of_any_length(spark):
    """A run of thousands of letters is parted, a misread one is repaired, and neither is dropped."""
    rnd = random.Random(4)
    words = ["tariff", "office", "gaskets", "lanterns", "numbers", "heading", "crushed"]
    chain = [rnd.choice(words) for _ in range(600)]
    long = "".join(rnd.choice("abcdefghjkqrstuvxyz") for _ in range(700))
    wrong = long[:300] + "9" + long[301:] if long[300] == "g" else long[:300] + "rn" + long[301:]
    right = long if long[300] == "g" else long[:300] + "m" + long[301:]
    lines = [" ".join(rnd.choice(words) for _ in range(9)) for _ in range(800)] + ["".join(chain)] + [f"the {right} stands"] * 20 + [f"the {wrong} stands"]
    x = scan_noise.Lexicon(spark.createDataFrame([(1, 1, 1, "\n".join(lines), None, None, None)], PAGE), common=4)
    got = {r.word: r.repair for r in x.repairs().select("word", "repair").collect()}
    assert got == {"".join(chain): " ".join(chain), wrong: right}


def test_long_words_meet_by_segments():
    rnd = random.Random(5)
    for _ in range(300):
        w = "".join(rnd.choice("abcdefghiklmnorstuv") for _ in range(rnd.randint(28, 90)))
        read = w
        for _ in range(2):
            i = rnd.randrange(len(read) - 2)
            a, b = rnd.choice([(read[i : i + 1], ""), ("", "x"), (read[i : i + 1], "y"), *((b, a) for a, b in scan_noise.PAIRS if read.startswith(b, i))])
            read = read[:i] + b + read[i + len(a) :]
        assert scan_noise._keys(read, 0) & scan_noise._keys(w, 1), (read, w)
        full = scan_noise.distance(read, w)
        assert full <= 2.5 and scan_noise.distance(w, w) == 0


def test_scan_noise_of_nothing(spark):
    df, _ = corpus(spark)
    assert scan_noise.found_lines(df.where("false")).count() == 0
    empty = df.limit(1).selectExpr("section_key", "doc_id", "source_page", "cast(null as string) raw_text", "'' ocr_markdown", "image_ocr", "loaded_at")
    assert scan_noise.found_lines(empty).count() == 0


def test_once_keeps_one_of_each(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (2, "b", 5), (3, "c", None)], "section_key int, t string, loaded_at int")
    assert Counter(r.section_key for r in common.once(df).collect()) == {1: 1, 2: 1, 3: 1}


# --- queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.count() > 0
    if name in sql.SQL:
        assert rows_of(df) == sql_rows(database(data), sql.SQL[name])


@pytest.mark.parametrize(("name", "columns"), [("p2_found", "section_key bigint, field string, region int, kind string"), ("p3_found", "section_key bigint, field string, region int, line_no int, kind string"), ("p4_found", "section_key bigint, line_no int"), ("p5_found", "section_key bigint, line_no int"), ("p6_found", "section_key bigint, field string, cut string"), ("p7_ids", "doc_id bigint, ids array<int>"), ("p9_found", "doc_id bigint, end_char bigint")])
def test_columns_as_given(spark, data, name, columns):
    df = queries.QUERIES[name](spark, data)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns
    assert df.count() == df.distinct().count()


def test_runs_part_at_words_of_the_whole_lexicon(spark):
    """Parts that are no common word: seen once, beyond the number of common words, or with a look-alike far more frequent."""
    lines = ["river harbour bridge valley"] * 30 + ["the market opens"] * 30 + ["zwick fahnlog", "a zwickfahnlog b"]  # seen once each
    lines += ["tho markets opens"] * 3 + ["thomarkets are"]
    lines += [f"{w} quibble" for w in ["marhet"] * 3] + ["marhetquibble goes"] + ["market goes"] * 90
    df = spark.createDataFrame([(1, 1, 1, "\n".join(lines), None, None, None)], "section_key bigint, doc_id bigint, source_page int, raw_text string, ocr_markdown string, image_ocr array<struct<region:int,markdown:string>>, loaded_at timestamp")
    few = scan_noise.Lexicon(df, common=3)
    lost = {r.word: r.parts for r in few.lost.collect()}
    assert lost["zwickfahnlog"] == ["zwick", "fahnlog"] and lost["marhetquibble"] == ["marhet", "quibble"]
    assert lost == {r.word: r.parts for r in scan_noise.Lexicon(df).lost.collect()}
    assert {r.word for r in few.repairs().where("repair like '% %'").collect()} == set(lost)


def test_candidates_of_long_words_and_of_many_neighbours(spark):
    """Two misread spots in words of over 20 letters, one in words of over 32, and more than eight candidates, of which the neighbours pick."""
    long, longer = "rechtsschutzversicherungen", "donaudampfschifffahrtselektrizitaetenhauptbetrieb"
    short = "cocacncc"  # each c may be an e: 5 candidates of one spot and 10 of two
    at = [i for i, c in enumerate(short) if c == "c"]
    put = lambda *spots: "".join("e" if i in spots else c for i, c in enumerate(short))
    meant = [put(i) for i in at] + [put(i, j) for i in at for j in at if i < j]
    lines = [f"die {long} gelten"] * 20 + [f"die {longer} fahren"] * 20 + ["die rcchtsschutzvers1cherungen gelten", "die donaudampfschifffahrtselektrizitaetenhauptbetr1eb fahren"]
    lines += [f"vor {w} nach" for w in meant[:-1] for _ in range(20)] + [f"xylophon {meant[-1]} quartett"] * 10 + [f"xylophon {short} quartett"]
    df = spark.createDataFrame([(1, 1, 1, "\n".join(lines), None, None, None)], "section_key bigint, doc_id bigint, source_page int, raw_text string, ocr_markdown string, image_ocr array<struct<region:int,markdown:string>>, loaded_at timestamp")
    x = scan_noise.Lexicon(df)
    got = {r.word: r.repair for r in x.repairs().select("word", "repair").collect()}
    assert got["rcchtsschutzvers1cherungen"] == long and got["donaudampfschifffahrtselektrizitaetenhauptbetr1eb"] == longer
    assert x.candidates.where(f"word = '{short}'").count() == 15 and got[short] == meant[-1]
