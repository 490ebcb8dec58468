"""Look-alikes, pieces, tokens, sentences against brute force."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import charforms, chunking, mixture, sentences, tokens

# --- one form of characters


@pytest.mark.parametrize(
    ("line", "form"),
    [
        ("no break thin", "no break thin"), ("zero​width s­oft ﻿bom", "zerowidth soft bom"), ("Ａｂｃ １２", "Abc 12"), ("\U0001d7f9\U0001d7fa", "34"), ("café", "café"), ("ﬁle", "file"),
        ("rеgіѕtry", "registry"), ("реѕо es", "peso es"), ("Οhne Zoll", "Ohne Zoll"), ("wrote∶ yes", "wrote: yes"), ("note‚ the", "note, the"), ("double‑walled", "double-walled"),
    ],
)
def test_forms(line, form):
    assert charforms.canonical_line(line) == form


@pytest.mark.parametrize("line", ["Каждая поправка с окна", "γ-lactone 5 μm", "品目，但。", "“provisional” — it’s", "25 m² ½ 3 °C", "éńş", "", "‚Nein‘ sagt", "क्‍ष", "mag. Η"])
def test_no_cases(line):
    assert charforms.canonical_line(line) == line


OF_EVERY_SCRIPT = [
    ("5 \u212a, 3 \u212b", "5 K, 3 \u00c5"), ("\u304b\u3099", "\u304c"), ("\u1112\u1161\u11ab", "\ud55c"), ("\u0958", "\u0915\u093c"), ("\uf900", "\u8c48"), ("\u2172 \u2163", "iii IV"), ("a\u3164b", "ab"), ("a\u2800b", "a b"),
    ("x\U000e0041\u845b\U000e0100", "x\u845b"), ("\ufedf\ufe8e", "\u0644\u0627"), ("\u2f00", "\u4e00"), ("\u05d0\u05b8\u05bc", "\u05d0\u05b8\u05bc"), ("\u05d0\u05bc\u05b8", "\u05d0\u05b8\u05bc"), ("\u0e33 \u00b5 \u3131 \u2026 \u2103 \u2116", "\u0e33 \u00b5 \u3131 \u2026 \u2103 \u2116"),
    ("\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f3f4\U000e0067\U000e0062\U000e007f"),
]


def test_forms_of_every_script(spark):
    assert [charforms.canonical_line(a) for a, _ in OF_EVERY_SCRIPT] == [b for _, b in OF_EVERY_SCRIPT]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(OF_EVERY_SCRIPT)], "section_key int, raw_text string")
    assert {r.section_key for r in charforms.changed_lines(df).collect()} == {k for k, (a, b) in enumerate(OF_EVERY_SCRIPT) if a != b}
    chars = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    lines = [x for x in (f"a{a}{b}" for a in ("", "\u304b", "\u1112") for b in chars) if unicodedata.normalize("NFC", x) != x]
    assert len(lines) > 1000 and spark.createDataFrame([(x,) for x in lines], "s string").where(~charforms.unstable(F.col("s"))).count() == 0


@given(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\n"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_form_is_stable(line):
    once = charforms.canonical_line(line)
    assert charforms.canonical_line(once) == once


@given(st.text(alphabet=st.one_of(st.sampled_from([chr(k) for k in sorted(charforms._NFC_CODES | charforms._MARK_CODES)]), st.sampled_from("aeo \u0430\u0435\u03bf\u1100\u1161\u304b\u0915")), max_size=12))
@settings(max_examples=1000, deadline=None)
def test_segments_make_the_whole_line_composed(line):
    """Segments alone are normalized, yet the line is in NFC, before and after letters are folded."""
    assert charforms._composed(line) == unicodedata.normalize("NFC", line)
    form = charforms.canonical_line(line)
    assert unicodedata.normalize("NFC", form) == form == charforms.canonical_line(form)


def test_spark_equals_python_and_nulls(spark):
    texts = ["a b\nplain\nＡ", None, "", "plain", "x" * 50_000 + "​", "a b\nplain\nＡ"]
    df = spark.createDataFrame([(i % 5, t, "clash") for i, t in enumerate(texts)], "section_key int, raw_text string, canonical_line string")
    got = {(r.section_key, r.line_no) for r in charforms.changed_lines(df.select("section_key", "raw_text")).collect()}
    assert got == {(0, 1), (0, 3), (4, 1)}
    assert [r.c for r in charforms.with_canonical(df, "raw_text", "c").collect()] == [None if t is None else charforms.canonical_text(t) for t in texts]
    assert charforms.changed_lines(df.where("false").select("section_key", "raw_text")).count() == 0


def test_quick_check_misses_nothing(spark):
    chars = [chr(c) for c in range(0x20, 0x2FFFF) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    changed = [c for c in chars if charforms.canonical_line(f"a{c}b") != f"a{c}b"]
    df = spark.createDataFrame([(f"a{c}b",) for c in changed], "s string")
    assert df.where(~charforms.unstable(F.col("s"))).count() == 0


# --- pieces


def check_pieces(text, found, limit, overlap):
    strength = chunking.strengths(__import__("numpy").frombuffer(text.encode("utf-32-le"), "uint32"))
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for a, b, forced in found:
        assert 0 < b - a <= limit and (forced or strength[b])
    for (a, b, _), (c, d, _) in zip(found, found[1:], strict=False):
        assert a <= c <= b < d and b - c <= overlap and (strength[c] or b - c == overlap)
    run = re.search(f"[A-Za-z0-9]{{{limit + 1},}}", text)
    assert any(f for *_, f in found) == bool(run)


@given(st.lists(st.tuples(st.sampled_from(["x", "\n\n", ". ", " ", "é", "。", "-"]), st.integers(1, 45)), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_of_any_text(parts):
    text = "".join(c * n for c, n in parts)
    if len(text) > 40:
        check_pieces(text, chunking.cuts([text], 40, 8)[0], 40, 8)


def test_pieces_agree_alone_and_together():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["word ", "a", "\n", "9" * 30, ". "]) for _ in range(rnd.randint(50, 300))) for _ in range(50)]
    assert chunking.cuts(texts, 50, 10) == [chunking.cuts([t], 50, 10)[0] for t in texts]


def test_pieces_follow_the_greedy_walk():
    """The doubled table marks what a walk from cut to cut meets."""
    import numpy as np

    text = "some words here. " * 200
    at, start, nxt, forced = chunking._successors(np.frombuffer(text.encode("utf-32-le"), np.uint32), 200, 30)
    walk, k = [], 0
    while at[k] < len(text):
        walk.append((int(start[k]), int(at[nxt[k]]), bool(forced[k])))
        k = nxt[k]
    assert chunking.cuts([text], 200, 30)[0] == walk


def test_pieces_in_spark(spark):
    long = "paragraph one goes on. " * 300
    rows = [(1, long, None), (1, long, None), (2, "short", ""), (3, "z" * 2001, None), (4, None, "y" * 2000), (5, "z" * 2000 + " " + "z" * 2000, None)]
    df = spark.createDataFrame(rows, "section_key int, content string, layout_text string")
    got = {(r.section_key, r.field): r.cut for r in chunking.oversized(df).collect()}
    assert got == {(1, "content"): "natural", (3, "content"): "forced", (5, "content"): "natural"}
    pieces = chunking.pieces(df).where("section_key = 1").orderBy("piece_no").collect()
    assert "".join(p.piece[p.overlap :] for p in pieces) == long and all(len(p.piece) <= 2000 for p in pieces)
    assert chunking.pieces(df).where("section_key in (2, 4)").count() == 3


# --- tokens


@pytest.fixture(scope="module")
def coder():
    return tokens.encoder(f"{tokens.FOLDER}/{tokens.BYTE_BPE_50K}")


@pytest.fixture(scope="module")
def other():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{tokens.FOLDER}/{tokens.BYTE_BPE_50K}", "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_merging(coder, other):
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice("etaoin shrdlu\n0123é中р.,'") for _ in range(rnd.randint(0, 60)))
        assert coder.encode(text) == other.encode_ordinary(text)
    for text in ("", " ", "<|endoftext|>", "a" * 5000, "‍\U0001f469\U0001f3fd"):
        assert coder.encode(text) == other.encode_ordinary(text)


def test_tokens_append_and_edit(coder, other):
    p = tokens.Prefix(coder.v, b"unbeliev")
    p.append(b"able")
    assert p.ids() == other.encode_ordinary("unbelievable")
    p.cut(8)
    assert p.ids() == other.encode_ordinary("unbeliev")
    text = "The quick brown fox doesn't jump over 1234 dogs."
    for start in range(len(text)):
        for new in ("", "x", " y "):
            assert coder.reencode(text, coder.encode(text), start, min(len(text), start + 2), new) == other.encode_ordinary(text[:start] + new + text[start + 2 :])


def test_tokens_in_spark(spark, other):
    texts = ["some text", None, "", "x y " * 20_000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, memo string")
    got = {r.doc_id: r.ids for r in tokens.with_ids(df).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert [r[0] for r in df.orderBy("doc_id").select(tokens.n_ids(F.col("text"))).collect()] == [len(got[i]) for i in range(4)]


# --- sentences


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("One. Two!  Three?", ["One.", "Two!", "Three?"]), ("See Fig. 3 and cf. Chapter 4 at 17.30 hrs. the rest. End", ["See Fig. 3 and cf. Chapter 4 at 17.30 hrs. the rest.", "End"]), ("Crates of P. T. Zul and Q. Bel. Next.", ["Crates of P. T. Zul and Q. Bel.", "Next."]),
        ('It reads "Keep dry. Do not stack." on all. He said: "Done." Then left.', ['It reads "Keep dry. Do not stack." on all.', 'He said: "Done."', "Then left."]), ("It was ... not found. Closed at 5 p.m. Then", ["It was ... not found.", "Closed at 5 p.m.", "Then"]), ("checked. pH values rose.Heading 5", ["checked.", "pH values rose.", "Heading 5"]),
        ("Head\n\nline one\ngoes on. Two", ["Head", "line one\ngoes on.", "Two"]), ("Text.\n- item one. More\n- item (5.1),\nAfter", ["Text.", "- item one. More", "- item (5.1),", "After"]), ("品目5.2包。在哪里？“对吗？”离开。", ["品目5.2包。", "在哪里？", "“对吗？”离开。"]),
        ("กขค งจฉ", ["กขค", "งจฉ"]), ("Πού; Η αρχή. Τ", ["Πού;", "Η αρχή.", "Τ"]), ("Erfasst sind z. B. Körbe ab dem 18. Stück. Ende", ["Erfasst sind z. B. Körbe ab dem 18. Stück.", "Ende"]),
        ("See https://a.org/x?Id=3 for more. Go to www.b.org/Y.Z!", ["See https://a.org/x?Id=3 for more.", "Go to www.b.org/Y.Z!"]), ("At https://a.org/x. Then on", ["At https://a.org/x.", "Then on"]), ("Mr. Smith of Corp. Inc. came.", ["Mr. Smith of Corp. Inc. came."]),
        ("Before\n            12. Numbered far in\n\nNext", ["Before\n            12. Numbered far in", "Next"]),
        ("(All of it. Really.) Next.", ["(All of it.", "Really.)", "Next."]), ("   ", []), ("", []), (None, []), ("a\r\n\r\nb\rc", ["a", "b\rc"]), ("list_3.csv and x.invalid/v3.4 hold. ¿Qué? Sí", ["list_3.csv and x.invalid/v3.4 hold.", "¿Qué?", "Sí"]),
    ],
)
def test_sentences(spark, text, wanted):
    df = spark.createDataFrame([(1, text, "clash")], "doc_id int, text string, end string")
    rows = sentences.sentences(df).orderBy("sentence_no").collect()
    assert [r.sentence for r in rows] == wanted
    assert [text[r.start_char : r.end_char] for r in rows] == wanted
    assert [r.end_char for r in sentences.sentence_ends(df).orderBy("end_char").collect()] == [r.end_char for r in rows]


def test_sentences_lose_nothing(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in sentences.sentences(spark.read.parquet(f"{data}/documents.parquet")).orderBy("doc_id", "sentence_no").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    for d, t in docs.items():
        assert re.sub(r"\s", "", "".join(got.get(d, []))) == re.sub(r"\s", "", t or "")


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "A word. " * 20_000), (2, "x" * 300_000), (3, '"' + "y. " * 20_000)], "doc_id int, text string")
    got = {r.doc_id: r["count"] for r in sentences.sentence_ends(df).groupBy("doc_id").count().collect()}
    assert got[1] == 20_000 and got[2] == 1


def test_long_quotation_is_one_sentence(spark):
    inner = "Keep it dry. Do not stack. " * 20_000
    texts = [f"It reads {a}{inner}{b} on all. Next." for a, b in ('""', "\u201c\u201d", "\u201e\u201c", "\u00ab\u00bb")]
    got = sentences.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "sentence_no").collect()
    assert [r.sentence for r in got] == [x for t in texts for x in (t[: -len(" Next.")], "Next.")]


def test_offsets_of_many_pieces_equal_those_of_few(spark, monkeypatch):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["A b. ", "C\n\n", "- d\n", "\u54c1\u3002", "e "]) for _ in range(n)) for n in (0, 1, 2, 3, 255, 600, 1000) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = lambda: sorted(tuple(r) for r in sentences.sentences(df).select("doc_id", "start_char", "end_char").collect())
    got = found()
    monkeypatch.setattr(sentences, "FOLD", 10**9)
    assert got == found()
    monkeypatch.setattr(sentences, "FOLD", 0)
    assert got == found()


# --- mixture


def small(spark, sizes, feeds):
    rows = [(k, s, n) for k, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint"), spark.createDataFrame(feeds, "source string, target_weight double, max_repeats int")


def test_mixture_meets_shares_and_caps(spark):
    rnd = random.Random(2)
    sizes = [("a", rnd.randint(1, 400)) for _ in range(300)] + [("b", rnd.randint(1, 300)) for _ in range(20)] + [("c", 5000)]
    ids, feeds = small(spark, sizes, [("a", 5.0, 1), ("b", 3.0, 4), ("c", 2.0, 2), ("none", 1.0, 1), ("a", 5.0, 1)])
    x = mixture.mixture(None, feeds, sizes=ids).collect()
    quota = {r.source: r.quota for r in mixture.plan(ids, feeds).collect()}
    by_slot, uses, tok = {}, {}, {}
    n = dict((k, v) for k, (_, v) in enumerate(sizes))
    for r in x:
        assert 0 <= r.from_token < r.to_token <= n[r.doc_id]
        by_slot[r.slot] = by_slot.get(r.slot, 0) + r.to_token - r.from_token
        uses[r.source] = max(uses.get(r.source, 0), r.use)
        tok[r.source] = tok.get(r.source, 0) + r.to_token - r.from_token
    assert tok == {k: v for k, v in quota.items() if v}
    assert sorted(by_slot.values(), reverse=True)[: -len(tok)] == [mixture.BLOCK] * (len(by_slot) - len(tok)) and sorted(by_slot) == list(range(len(by_slot)))
    assert uses["a"] <= 1 and uses["b"] <= 4 and uses["c"] <= 2
    total = sum(tok.values())
    assert all(abs(tok[k] - total * share) <= 3 for k, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    spans = sorted((r.source, r.doc_id, r.use, r.from_token, r.to_token) for r in x)
    for p, q in zip(spans, spans[1:], strict=False):
        assert p[:3] != q[:3] or p[4] == q[3]
    shares = {r.source: r for r in mixture.shares(None, feeds, sizes=ids).collect()}
    assert shares["none"].actual_share == 0 and abs(shares["none"].target_share - 1 / 11) < 1e-9
    assert {k: v.mixed_tokens for k, v in shares.items() if v.mixed_tokens} == tok


@pytest.mark.parametrize("total", [3_000, 9_000, 60_000, 10**9, "corpus"])
def test_mixture_of_a_given_length(spark, total):
    """Sources that run out give all; the others share the rest by their weights."""
    sizes, feeds = [("a", 40_000), ("b", 1_000), ("c", 3_000), ("d", 200)], [("a", 5.0, 1), ("b", 3.0, 4), ("c", 2.0, 2), ("d", 1.0, 1), ("e", 9.0, 1)]
    ids, table = small(spark, sizes, feeds)
    most = {s: n * next(f[2] for f in feeds if f[0] == s) for s, n in sizes}
    weight = {f[0]: f[1] for f in feeds if f[0] in most}
    left, want, gone = float(44_200 if total == "corpus" else total), {}, set()
    while True:  # by hand: fill by weights, take out what runs over, again
        open_ = {s: left * weight[s] / sum(w for t, w in weight.items() if t not in gone) for s in most if s not in gone}
        over = {s for s, v in open_.items() if v >= most[s]}
        if not over:
            want |= open_
            break
        want |= {s: most[s] for s in over}
        left -= sum(most[s] for s in over)
        gone |= over
    got = {r.source: r.mixed_tokens for r in mixture.shares(None, table, total=total, sizes=ids).collect()}
    assert got["e"] == 0 and all(abs(got[s] - want[s]) <= 1 for s in most)


def test_mixture_of_nothing(spark):
    ids, feeds = small(spark, [("a", 5)], [("b", 1.0, 1)])
    assert mixture.mixture(None, feeds, sizes=ids).count() == 0
    assert mixture.mixture(None, feeds.where("false"), sizes=ids).count() == 0
    assert mixture.mixture(None, feeds, sizes=ids.where("false")).count() == 0


def test_mixture_prefixes_stay_close(spark):
    ids, feeds = small(spark, [("a", 100_000), ("b", 100_000)], [("a", 3.0, 1), ("b", 1.0, 1)])
    x = mixture.slots(mixture.plan(ids, feeds)).orderBy("slot").collect()
    got = 0
    for k, r in enumerate(x, 1):
        got += r.source == "a"
        assert abs(got - 0.75 * k) < 8


def test_mixture_from_texts(spark, data):
    docs, feeds = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/feeds.parquet")
    pieces = mixture.mixture(docs, feeds)
    full = mixture.with_pieces(pieces, docs).collect()
    assert full and all(len(r.ids) == r.to_token - r.from_token for r in full)
