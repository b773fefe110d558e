"""State operators on small sequences, and the plans of audits that SQL can't show."""

import pytest

from groundwork.operators import folds
from groundwork.plans import audit


def played(step, rows):
    state = {}
    return [step(state, r) for r in rows]


def test_a_branch_that_has_not_begun_keeps_its_slots():
    step = folds.slot_borrowing(total=6, allocations={"a": 2, "b": 2}, reserve=1)
    # a takes its own two, borrows the one that is neither owed to b nor reserved, and no more; b still gets its two
    assert played(step, [("a",), ("a",), ("a",), ("a",), ("b",), ("b",), ("b",)]) == [(True, False), (True, False), (True, True), (False, False), (True, False), (True, False), (False, False)]


def test_memory_upsert():
    step = folds.memory_upsert(most=2)
    assert played(step, [("One", 1), (" one ", 2), ("two", 3), ("", 4), (None, 4), ("three", 5), ("two", 6), ("one", 7)]) == [(True, 0), (False, 1), (True, 0), (False, None), (False, None), (True, 0), (True, 0), (False, 2)]
    # a new one may be what goes: all others were hit
    step = folds.memory_upsert(most=1)
    assert played(step, [("a", 1), ("a", 2), ("b", 3), ("b", 4), ("a", 5)]) == [(True, 0), (False, 1), (True, 0), (True, 0), (False, 2)]


def test_memory_upsert_by_vector():
    step = folds.memory_upsert(near=0.95)
    rows = [("a", 1, [0, 1], [0.6, 0.8]), ("b", 2, [0, 1], [0.61, 0.7924]), ("c", 3, [0, 1], [1.0, 0.0]), ("a", 4, [0, 1], [0.6, 0.8]), ("d", 5, None, None)]
    assert played(step, rows) == [(True, 0), (False, 1), (True, 0), (False, 2), (True, 0)]


def test_lru_cache():
    step = folds.lru_cache(ttl_s=10, most=2)
    s = 1_000_000
    assert played(step, [(0, "a"), (s, "b"), (2 * s, "a"), (3 * s, "c"), (4 * s, "b"), (5 * s, "c"), (13 * s, "c"), (14 * s, "c")]) == [(False, False), (False, False), (True, False), (False, True), (False, True), (True, False), (False, False), (True, False)]


def test_job_queue():
    step = folds.job_queue(lease_s=10, attempts=2)
    s = 1_000_000
    rows = [(0, "add", 1), (0, "add", 2), (0, "claim", None), (s, "claim", None), (s, "claim", None), (11 * s, "claim", None), (12 * s, "fail", 1), (12 * s, "claim", None), (13 * s, "fail", 1), (13 * s, "complete", 2), (14 * s, "complete", 1), (14 * s, "claim", None)]
    assert played(step, rows) == [(None, "queued"), (None, "queued"), (1, "running"), (2, "running"), (None, None), (1, "running"), (None, "queued"), (1, "running"), (None, "failed"), (None, "completed"), (None, "failed"), (None, None)]


def test_paired_calls(spark):
    rows = [(1, "k", 10, "call"), (2, "k", 20, "call"), (3, "k", 25, "other"), (4, "k", 30, "result"), (5, "k", 40, "result"), (6, "j", 50, "result"), (7, None, 1, "call"), (8, None, 5, "result")]
    df = spark.createDataFrame(rows, "id int, tool string, us long, kind string")
    got = {r.id: (r.call.id if r.call else None, r.waited) for r in audit.paired_calls(df, ["tool"], ["us", "id"], "kind", df["us"]).collect()}
    assert got == {4: (2, 10), 5: (None, None), 6: (None, None), 8: (7, 4)}


def test_ledger_and_rendered(spark):
    df = spark.createDataFrame([("r", "u1", "b", 2, "x" * 5), ("r", "u2", "a", 1, "y" * 5), ("r", "u1", "a", 3, None), ("r", None, "a", 0, "z")], "run string, url string, branch string, place int, t string")
    led = {r.source: (r.n, list(r.branches), r.seen) for r in audit.ledger(df, "run", df["url"], df["branch"], ["place"]).collect()}
    assert led == {"u2": (1, ["a"], 1), "u1": (2, ["a", "b"], 2)}
    (shown,) = audit.rendered(df, "run", [df["place"]], "t", most=8, join="|").collect()
    assert (shown.shown, shown.dropped) == ("z|yyyyy|", 5)


def test_first_enough(spark):
    rows = [("a", 1, True, "s"), ("a", 2, True, "s"), ("a", 3, False, "t"), ("a", 4, True, "t"), ("a", 5, True, "u"), ("b", 1, True, "s"), ("b", 2, True, None)]
    df = spark.createDataFrame(rows, "k string, place int, ok boolean, site string")
    assert {tuple(r) for r in audit.first_enough(df, "k", ["place"], "ok", "site").collect()} == {("a", 4, 4), ("b", 2, None)}


def test_unlisted_models_cost_what_the_dearest_does(spark):
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("x", 3.0, 9.0)], "model string, i double, o double")
    df = spark.createDataFrame([("m", 1_000_000, 1_000_000), ("?", 1_000_000, None), (None, None, 1_000_000)], "name string, i long, o long")
    assert sorted(r.cost for r in audit.priced(df, "name", ["i", "o"], prices).collect()) == [3.0, 3.0, 9.0]


def test_incoherent_expectations():
    assert audit.incoherent({"tokens": 1, "calls": 0}, {"recall": 1.5, "grounding": 0.9}, {"a", "b"}, {"b"}) == ["budget.calls must be a positive number", "recall is outside 0..1", "b is both required and forbidden"]
    assert audit.incoherent({"tokens": 1.5}, {}, {"a"}, {"b"}) == []


def test_placed(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"Intro. {words.upper()}, end"), (2, f"x{words}"), (3, words[:-9]), (4, None), (5, f"{words}\n{words}")], "d long, t string")
    items = spark.createDataFrame([(1, words), (2, "one two"), (3, None), (4, "no " * 20), (5, words + " end")], "i int, a string")
    got = {r.i: (r.documents, r.first, r.problem) for r in audit.placed(items, "i", "a", docs, "d", "t").collect()}
    assert got == {1: (2, 1, "several"), 2: (0, None, "too short"), 3: (0, None, "missing"), 4: (0, None, "nowhere"), 5: (1, 1, None)}


@pytest.mark.parametrize("text, want", [("p. 3", (3, None)), ("Page 12", (12, None)), ("7 of 9", (7, None)), ("section 4", (None, "section 4")), ("", (None, ""))])
def test_locator(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").selectExpr(f"{audit.locator('t')} as l").first().l
    assert tuple(r) == want


def test_articles(spark):
    from groundwork.sources.html import articles

    html = "<html><head><title>T</title><meta name='author' content='A'></head><body><nav>Menu Menu Menu Menu Menu Menu Menu Menu Menu</nav><article><time datetime='2020-01-02'>x</time><p>" + "A sentence of the article that is long enough. " * 3 + "</p></article></body></html>"
    (r,) = articles(spark.createDataFrame([(1, html, "https://e.org/x"), (2, None, "u")], "k int, h string, u string"), "k", "h", "u", most=None).collect()
    assert (r.k, r.title, r.author, r.published_at) == (1, "T", "A", "2020-01-02") and r.text.startswith("A sentence") and "Menu" not in r.text


def test_suffixes_from_a_file(tmp_path):
    from groundwork.functions.urls import read_suffixes

    path = tmp_path / "suffixes"
    path.write_text("// note\ncom\nco.uk // here\n*.ck\n!www.ck\nCOM.au\n")
    assert read_suffixes(str(path)) == "co.uk com.au"


def test_ranks_are_those_of_the_sorted_values(spark):
    import math
    import random

    from groundwork.operators import stats

    rng = random.Random(2)
    groups = {"a": [rng.randint(0, 50) for _ in range(501)], None: [7, 7, 9], "one": [3], "wide": list(range(2000))}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: (r.p5, r.p50, r.p100, r.n) for r in stats.percentile_nearest(df, ["g"], "v", 5, 50, 100).collect()}
    assert got == {g: (*[sorted(vs)[max(1, math.ceil(len(vs) * p / 100)) - 1] for p in (5, 50, 100)], len(vs)) for g, vs in groups.items()}
    every = sorted(v for vs in groups.values() for v in vs)
    (r,) = stats.percentile_floor(df, [], "v", 50).collect()
    assert (r.p50, r.n) == (every[min(len(every) - 1, len(every) * 50 // 100)], len(every))
    assert stats.percentile_floor(df.limit(0), [], "v", 50).count() == 0 == stats.percentile_floor(df.limit(0), ["g"], "v", 50).count()
