"""Sentences, citations, chunks, folds and styles on small cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.operators import folds
from groundwork.plans import answers as A
from groundwork.plans import chunks as C
from groundwork.plans import evidence as E
from groundwork.sources.html import article


def texts(answer):
    return [(s.text, s.orphan) for s in E.sentences(answer)]


def test_trailing_markers_join_the_sentence_before():
    assert texts("Rows are stored together. [1] Columns are stored apart. [2]") == [("Rows are stored together. [1]", False), ("Columns are stored apart. [2]", False)]


def test_leading_markers_stay_where_the_answer_leads():
    assert texts("[1] Logs are written first.\n\n[2] Pages are written later.") == [("[1] Logs are written first.", False), ("[2] Pages are written later.", False)]


def test_a_marker_alone_is_an_orphan():
    assert texts("First claim.\n\n[3]") == [("First claim.", False), ("[3]", True)]


def test_list_items_and_emphasis_end_sentences():
    assert len(texts("Intro text.\n- one item\n- another item\n\n**Bold** opens. It ends.")) == 5


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n-[1]2,A", max_size=80))
def test_sentences_stand_in_the_text_in_order(answer):
    at = 0
    for s in E.sentences(answer):
        assert answer[s.start : s.end] == s.text and s.start >= at
        at = s.end


def test_validation():
    sources = {1: E.content_words("compilers translate source programs"), 2: E.content_words("databases store rows")}
    got = E.validate("Compilers translate programs [1]. Databases eat lunch daily [2, 9]. The sources do not cover parsers [1]. [7]", sources)
    assert got["invalid"] == [9, 7] and got["cited"] == [1, 2] and got["uncited"] == []
    assert (got["cited_sentences"], got["supported_sentences"], got["freed"]) == (2, 1, 1)
    assert got["groundedness"] == 0.5 and "parsers." in got["answer"]


def test_validation_without_sources():
    got = E.validate("Nothing is known [1].", {})
    assert got["cited_sentences"] == 0 and got["groundedness"] is None and got["invalid"] == [1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc. ?\n", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_chunks_cover_the_text(text, size, overlap):
    pieces = C.cuts(text, size, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, z), (b, _) in zip(pieces, pieces[1:]):
        assert a < b <= z and z - a <= size


def test_chunks_know_page_and_line():
    text = "x" * 50 + "\n\n" + "word " * 30 + "end. " + "y" * 100
    rows = C.page_chunks([(4, None, text), (5, "five", "short")], size=120, overlap=10)
    assert rows[0][1:3] == (4, "p. 4") and rows[0][5] == 1 and all(len(r[6]) >= C.LEAST for r in rows)
    assert [r[0] for r in rows] == list(range(len(rows))) and C.page_chunks([(1, None, None), (2, None, "")]) == []


def test_passages():
    parts = C.passages("a" * 1000 + "\n\n" + "b" * 500 + "\n\n\n" + "c" * 30)
    assert [len(p) for p in parts] == [1000, 532]


def test_token_bucket():
    step, state = folds.token_bucket(2.0, 1.0), {}
    assert [step(state, (us,))[0] for us in (0, 0, 0, 1_000_000, 1_000_000)] == [True, True, False, True, False]


def test_breaker_opens_probes_and_closes():
    step, state = folds.circuit_breaker(2, 10), {}
    s = 1_000_000
    seen = [step(state, (t * s, failed, True)) for t, failed in ((0, True), (1, True), (5, False), (12, True), (13, False), (30, False), (31, False))]
    assert seen == [("closed", False), ("closed", False), ("open", True), ("half_open", False), ("open", True), ("half_open", False), ("closed", False)]


def test_budget_caps_for_good_and_refunds():
    step, state = folds.budget_gate(3, 2, 2), {}
    assert [step(state, x)[0] for x in (("search", True), ("search", False), ("other", False), ("fetch", False), ("other", False), ("other", False))] == [True, True, True, True, False, False]


def test_fold_by_key_with_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 0), (None, 1, 5), (None, 2, 6), ("b", 1, 7)], "k string, o int, us long")
    step = lambda state, row: (state.setdefault("n", 0), state.update(n=state["n"] + 1))[:1]
    got = {(r.k, r.o): r.nth for r in folds.fold_by_key(df, "k", ["o"], ["us"], step, "nth int", ["o"]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, (None, 1): 0, (None, 2): 1, ("b", 1): 0}
    assert folds.fold_by_key(df.limit(0), "k", ["o"], ["us"], step, "nth int").count() == 0


def test_allocation():
    assert folds.deep_allocation(24, 4, 5) == (5, 4) and folds.deep_allocation(10, 4, 5) == (1, 6)


@pytest.mark.parametrize(
    ("text", "plain"),
    [("pages 10–20 tell", "pages 10 to 20 tell"), ("one — two", "one, two"), ("`a—b` and \"c—d\"", "`a—b` and \"c—d\""), ("see https://x.org/a–b now", "see https://x.org/a–b now")],
)
def test_plain_style(text, plain):
    assert A.plain_style(text) == plain


def test_loose_json():
    assert A.loose_json('```json\n{"a": 1}\n```') == {"a": 1} and A.loose_json("so: [1, 2] is it") == [1, 2] and A.loose_json("none") is None


def test_article():
    body = "A sentence that is long enough to count as a paragraph of text."
    html = f"<html><head><title>T</title><meta name='author' content='Ann'></head><body><nav><a href='x'>Home of everything and more than forty letters</a></nav><article><p>{body}</p><p>{body}<br>short</p><script>x()</script></article></body></html>"
    got = article(html, "https://www.example.org/a")
    assert got["title"] == "T" and got["author"] == "Ann" and got["text"] == f"{body}\n\n{body}"
    assert article("", "https://host.example/x")["title"] == "host.example" and not re.search("Home", got["text"])
