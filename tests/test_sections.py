"""Sections by made cases and by what must hold of any document."""

import random

from quire.operators import sections as S

LONG = "c" * 200
SMOOTH = [
    ([("A", LONG), ("B", LONG)], [("A", LONG), ("B", LONG)]),
    ([("A", LONG), ("B", "b"), ("C", LONG)], [("A", f"{LONG}\nB\nb"), ("C", LONG)]),
    ([("A", "a"), ("B", LONG)], [("B", f"A\na\n{LONG}")]),
    ([("A", "a"), ("B", "b"), ("C", LONG), ("D", "")], [("C", f"B\nA\na\nb\n{LONG}\nD")]),
    ([("A", "a"), ("B", "b")], [("B", "A\na\nb")]),
    ([("A", "a")], [("A", "a")]),
    ([("A", "x" * 120), ("B", "y" * 120), ("C", LONG)], [("B", f"A\n{'x' * 120}\n{'y' * 120}"), ("C", LONG)]),
    ([("", ""), ("B", LONG)], [("B", LONG)]),
]


def smoothed(spark, docs):
    rows = [(d, i, t, c) for d, s in enumerate(docs) for i, (t, c) in enumerate(s)]
    got = {d: [] for d in range(len(docs))}
    for r in S.smoothed(spark.createDataFrame(rows, "doc_id int, seq int, title string, content string")).orderBy("doc_id", "seq").collect():
        got[r.doc_id].append((r.title, r.content))
    return got


def test_short_sections_join(spark):
    got = smoothed(spark, [s for s, _ in SMOOTH])
    assert [got[d] for d in range(len(SMOOTH))] == [want for _, want in SMOOTH]


def test_smoothing_keeps_text_and_leaves_no_short_section(spark):
    rnd = random.Random(4)
    docs = [[(f"T{d}-{i}", f"<{d}-{i}>" + "c" * rnd.choice([0, 5, 90, 150, 192, 260])) for i in range(rnd.randint(1, 9))] for d in range(150)]
    for d, out in smoothed(spark, docs).items():
        text = "\n".join(x for s in out for x in s)
        places = [text.index(c) for _, c in docs[d]]
        assert places == sorted(places) and all(t in text for t, _ in docs[d])
        assert len(out) == 1 or all(len(c) >= S.MIN_CONTENT for _, c in out)
        titles = [t for t, _ in docs[d]]
        assert [titles.index(t) for t, _ in out] == sorted(titles.index(t) for t, _ in out)
        # what is long enough itself and isn't the first to be stays a section
        long = [t for t, c in docs[d] if len(c) >= S.MIN_CONTENT]
        assert set(long[1:]) <= {t for t, _ in out}


def sections_of(spark, text, mode="auto"):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r.title, r.content) for r in S.detect(S.text_lines(df), mode=mode).orderBy("seq").collect()]


def test_headings_split_and_merge(spark):
    long = "word " * 60
    text = f"Front matter here.\n\nIntroduction\n\nTo Flying\n\n{long}\n\nSecond Part\n{long}"
    got = sections_of(spark, text)
    assert [t for t, _ in got] == ["Introduction To Flying", "Second Part"]
    assert got[0][1].startswith("Preamble\nFront matter here.")


def test_dense_headings_stay_text(spark):
    # four headings two lines apart, with a body line between each, are a listing
    text = "\nbody text goes on here.\n\n".join(["Alpha Bravo", "Charlie Delta", "Echo Fox", "Golf Hotel"])
    assert [t for t, _ in sections_of(spark, text)] == ["Content"]


def lines(spark, text):
    return S.text_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))


def test_no_heading_is_one_section(spark):
    assert sections_of(spark, "just text.\nmore text.") == [("Content", "just text.\nmore text.")]
    assert sections_of(spark, None) == []


def test_glossary_letters(spark):
    body = "\n".join(f"{c}\n\nterm: meaning {'x' * 250}\n" for c in "ABC")
    got = sections_of(spark, "Glossary of terms.\n\n" + body)
    assert [t for t, _ in got] == ["A", "B", "C"]


def test_title_and_numbers(spark):
    df = spark.createDataFrame([(1, 0, "Preamble", "x"), (1, 1, "Chapter 3: The  Rules", "y"), (2, 0, "Only", "z")], "doc_id int, seq int, title string, content string")
    assert dict((r.doc_id, r.title) for r in S.document_title(df).collect()) == {1: "The Rules", 2: "Only"}
    warned = [r.warning for r in S.validation(S.numbered(df, df.doc_id)).collect()]
    assert sum("Only 1 section" in w for w in warned) == 1 and sum("unusually short" in w for w in warned) == 3
    three = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    assert [r.doc_id for r in S.validation(S.numbered(df, df.doc_id), documents=three).where("warning like '%No headings%'").collect()] == [3]


def test_glossary_by_name_lines_or_marks(spark):
    marks = "\n".join(f"{c}-{k}" for k, c in enumerate("ABCDE", 1)) + "\nA\nB\nC"
    docs = [(1, "plain text", "My_Glossary.pdf"), (2, "plain text", "other.pdf"), (3, "plain text", None), (4, "a GLOSSARY of terms", None), (5, marks, "x.pdf"), (6, "x\n" * 400 + "glossary", None)]
    df = S.text_lines(spark.createDataFrame(docs, "doc_id int, text string, name string"), keys=("doc_id", "name"))
    assert {r.doc_id: r.is_glossary for r in S.glossary_score(df, name="name").collect()} == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


WRAPPED = [
    (["One two", "three four"], ["One two three four"]),
    (["One two", "Three four"], ["One two", "Three four"]),
    (["One two.", "three"], ["One two.", "three"]),
    (["One two,", "Three (", "Four"], ["One two, Three ( Four"]),
    (["sepa-", "rate Well-", "Known-", "9 ends"], ["separate WellKnown9 ends"]),
    (["cut-", "- item"], ["cut-", "- item"]),
    (["a", "", "b"], ["a", "", "b"]),
    (["- item", "goes", "1. x", "y"], ["- item", "goes", "1. x", "y"]),
    (["plain", "a  b", "c"], ["plain", "a b", "c"]),
    (["Chapter 3", "on"], ["Chapter 3", "on"]),
    (["w" * 60, "Big"], ["w" * 60 + " Big"]),
    (["w" * 59, "Big"], ["w" * 59, "Big"]),
    (["w" * 30, "x" * 30, "Big", "Other"], ["w" * 30 + " " + "x" * 30 + " Big Other"]),
    (["  lead", "more  "], ["lead more"]),
    (["", "", ""], ["", "", ""]),
    (["see Chapter,", "x"], ["see Chapter, x"]),
    (["Chapter,", "3 a"], ["Chapter, 3 a"]),
    (["Chap-", "ter", "9 x"], ["Chapter", "9 x"]),
]


def joined(spark, docs):
    df = spark.createDataFrame([(d, i, x) for d, ls in enumerate(docs) for i, x in enumerate(ls)], "doc_id int, line_no int, line string")
    got = {d: [] for d in range(len(docs))}
    for r in S.joined_lines(df).orderBy("doc_id", "line_no").collect():
        got[r.doc_id].append(r.line)
    return got


def test_wrapped_lines(spark):
    got = joined(spark, [x for x, _ in WRAPPED])
    assert [got[d] for d in range(len(WRAPPED))] == [want for _, want in WRAPPED]


def test_joining_keeps_all_letters_and_breaks(spark):
    rnd = random.Random(9)
    parts = ["word", "cut-", "Big", "end.", "a,", "", "- item", "a  b", "Chapter 3", "long " * 13, "(", "x"]
    docs = [[rnd.choice(parts) for _ in range(rnd.randint(1, 12))] for _ in range(80)]
    for d, out in joined(spark, docs).items():
        bare = lambda ls: "".join(ls).replace(" ", "").replace("-", "")
        assert bare(out) == bare(docs[d]) and out.count("") == docs[d].count("")
        for fixed in ("- item", "Chapter 3", "a b"):  # these stand alone
            assert out.count(fixed) == [" ".join(x.split()) for x in docs[d]].count(fixed)


def test_long_run_of_wrapped_lines(spark):
    got = joined(spark, [["word"] * 200_000])
    assert got[0] == [" ".join(["word"] * 200_000)]


def test_table_blocks(spark):
    text = "a  b\nc  d\n\ne  f\nplain text\ng  h"
    got = S.table_blocks(lines(spark, text)).collect()
    assert [(r.first_line, r.last_line, r.n_rows, r.n_cols) for r in got] == [(0, 3, 3, 2)]
