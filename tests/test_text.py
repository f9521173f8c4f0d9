"""Markup functions against tables of inputs and expected strings."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressline.functions import text as tx

def _run(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


# (text, paragraphs to remove or None for all kept, marked-up body)
BODIES = [
    ("", None, ""),
    ("", 1, ""),
    ("a", None, "a"),
    ("a", 0, ""),
    ("a", 1, ""),
    ("a", -1, "a"),
    ("a\n\nb\n\nc", None, "a <PARAGRAH> b <PARAGRAH> c"),
    ("a\n\nb\n\nc", 0, ""),
    ("a\n\nb\n\nc", 1, "a <PARAGRAH> b"),
    ("a\n\nb\n\nc", 2, "a"),
    ("a\n\nb\n\nc", 9, ""),
    ("a\n\nb\n\nc", -1, "a"),
    ("a\n\nb\n\nc", -2, "a <PARAGRAH> b"),
    ("a\n\nb\n\nc", -9, "a <PARAGRAH> b <PARAGRAH> c"),
    ("x\n\n\ny", None, "x <PARAGRAH>  <NEW_LINE> y"),
    ("x\n\n\ny", 1, "x"),
    ("\n\n\n\n", None, " <PARAGRAH>  <PARAGRAH> "),
    ("\n\n\n\n", 1, " <PARAGRAH> "),
    ("élan\n\nçà va\nnon", None, "lan <PARAGRAH>  va <NEW_LINE> non"),
    ("élan\n\nçà va\nnon", 1, "lan"),
    ("one\ntwo\n\nthree", None, "one <NEW_LINE> two <PARAGRAH> three"),
    ("one\ntwo\n\nthree", -1, "one <NEW_LINE> two"),
]


def test_paragraph_removal_table(spark):
    rows = [(i, t, r) for i, (t, r, _) in enumerate(BODIES)]
    got = _run(spark, rows, "i int, t string, r int", "i", tx.format_body_only("t", F.col("r")).alias("o"))
    assert {r.i: r.o for r in got} == {i: want for i, (_, _, want) in enumerate(BODIES)}


# (body, headline, marked-up text)
ARTICLES = [
    ("a", None, " <HEADLINE>  <HEADLINE/>  <NEW_LINE>  <BODY> a <BODY/> "),
    ("", "", " <HEADLINE>  <HEADLINE/>  <NEW_LINE>  <BODY>  <BODY/> "),
    ("é b", "Élan vital", " <HEADLINE> Élan vital <HEADLINE/>  <NEW_LINE>  <BODY>  b <BODY/> "),
    ("a\n\nb", "a\rb", " <HEADLINE> a\rb <HEADLINE/>  <NEW_LINE>  <BODY> a <PARAGRAH> b <BODY/> "),
    ("a\nb", "x\u2028y", " <HEADLINE> x\u2028y <HEADLINE/>  <NEW_LINE>  <BODY> a <NEW_LINE> b <BODY/> "),
    ("a", "nbsp\u00a0here", " <HEADLINE> nbsp\u00a0here <HEADLINE/>  <NEW_LINE>  <BODY> a <BODY/> "),
]


def test_headline_body_markup(spark):
    rows = [(i, t, h) for i, (t, h, _) in enumerate(ARTICLES)]
    got = _run(spark, rows, "i int, t string, h string", "i", tx.format_headline_body("t", "h").alias("o"))
    assert {r.i: r.o for r in got} == {i: want for i, (_, _, want) in enumerate(ARTICLES)}


# (body, headline, headline read back, body read back): the padding of the markers stays
READ_BACK = [
    ("first line\nsecond\n\nthird", "Head line", " Head line ", "  \nfirst line\nsecond\n\nthird"),
    ("body", "a\rb\u2028c", " a\rb\u2028c ", "  \nbody"),
]


def test_decompile_restores_headline_and_body(spark):
    rows = [(i, t, h) for i, (t, h, _, _) in enumerate(READ_BACK)]
    df = spark.createDataFrame(rows, "i int, t string, h string")
    d = tx.decompile_headline_body(tx.format_headline_body("t", "h"))
    out = df.select("i", d["headline"].alias("hh"), d["body"].alias("bb")).collect()
    for r in out:
        _, _, head, body = READ_BACK[r.i]
        assert r.hh == head
        assert (r.bb.split(), r.bb.strip()) == (body.split(), body.strip())


def test_decompile_without_markers_raises(spark):
    df = spark.createDataFrame([("no markers here",)], "t string")
    with pytest.raises(Exception):
        df.select(tx.decompile_headline_body("t")["headline"]).collect()


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126) | st.just("\n"), max_size=60))
def test_format_decompile_roundtrip_ascii(spark, body):
    if "<" in body or ">" in body:
        return
    df = spark.createDataFrame([(body,)], "t string")
    r = df.select(tx.decompile_body_only(tx.format_body_only("t")).alias("o")).collect()[0]
    assert r.o == body


def test_word_count_uses_python_whitespace(spark):
    samples = ["a b", "a\u001cb", "a\u0085b　c", "a\tb\x0bc", "  lead  trail  ", "", "a b", "x​y"]
    got = _run(spark, [(s,) for s in samples], "t string", "t", tx.word_count("t").alias("n"))
    for r in got:
        assert r.n == len(r.t.split()), repr(r.t)


def test_caption_removal(spark):
    cases = [
        "Lead. FILE - In this file photo, a crowd.\nRest of it.",
        "A. FILE - one. B. FILE - two. C.",
        "FILE - no period at all",
        "FILE - first sentence. Then more.",
        "Text\nwith FILE - caption\nacross lines. After.",
    ]
    got = _run(spark, [(c,) for c in cases], "t string", "t", tx.remove_captions("t").alias("o"))
    for r in got:
        assert r.o == re.sub(r"([^.]*?FILE - [^.]*\.)", "", r.t)


def test_clean_ascii(spark):
    s = "abc é 😀 d e"
    r = _run(spark, [(s,)], "t string", tx.clean_ascii("t").alias("o"))[0]
    assert r.o == "".join(c for c in s if ord(c) < 128)


def test_title_search_null_and_case(spark):
    rows = [("The cat",), ("the dog",), (None,), ("Élan THE",)]
    df = spark.createDataFrame(rows, "title string")
    ci = [r.title for r in df.where(tx.title_matches("title", "the")).collect()]
    cs = [r.title for r in df.where(tx.title_matches("title", "the", case_sensitive=True)).collect()]
    allr = df.where(tx.title_matches("title", "")).count()
    assert sorted(ci) == ["The cat", "the dog", "Élan THE"]
    assert cs == ["the dog"]
    assert allr == 4


def test_marker_vocabulary():
    assert tx.HEADLINE_BODY_MARKERS == ["<PARAGRAH>", "<NEW_LINE>", "<HEADLINE>", "<HEADLINE/>", "<BODY>", "<BODY/>"]
    assert tx.BODY_ONLY_MARKERS == [" <PARAGRAH> ", " <NEW_LINE> "]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["FILE - ", ".", " ", "a", "b", "\n", "F", "é"]), max_size=40))
def test_caption_anchoring_is_equivalent(spark, parts):
    s = "".join(parts)
    r = spark.createDataFrame([(s,)], "t string").select(tx.remove_captions("t").alias("o")).collect()[0]
    assert r.o == re.sub(r"([^.]*?FILE - [^.]*\.)", "", s)
