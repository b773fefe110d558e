"""Leaks against brute force, and disguises that don't hide one."""

import random
import unicodedata

import pytest

from groundwork.llm import leaks
from groundwork.llm.leaks import find_leaks, winnow
from groundwork.llm.text import readings

ANCHOR = "The naïve model efficiently reads fifteen very different words before fläche ends the long passage here today"


def test_every_shared_span_keeps_a_common_gram():
    rng = random.Random(1)
    for _ in range(300):
        span = [rng.choice("abcdefg") for _ in range(12)]
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 20))] for _ in range(2))
        x, y = a + span + b, b + span + a
        assert set(winnow(x, 8, 5)[1].tolist()) & set(winnow(y, 8, 5)[1].tolist())
    assert len(winnow(["w"] * 11, 8, 5)[0]) == 0


@pytest.mark.parametrize(
    "text",
    [
        ANCHOR, ANCHOR.upper(), unicodedata.normalize("NFD", ANCHOR), ANCHOR.replace(" ", "\n"), ANCHOR.replace(" ", " [3, 4] "), ANCHOR.replace(" ", " "), ANCHOR.replace("fi", "ﬁ").replace("ffi", "ﬃ"),
        "<p>" + ANCHOR.replace("very ", "<b>very</b><br/>\n") + "</p>", ANCHOR.replace("different", "differ-\nent"), ANCHOR.replace("model", "mo\xaddel").replace("words", "wo⁠rds"),
        "**" + ANCHOR.replace("model", "_model_") + "**", ANCHOR.replace("ä", "&auml;").replace("ï", "&#239;"), "| " + ANCHOR.replace(" before", " |\n| before"),
    ],
)
def test_disguises(text):
    assert " ".join(readings(ANCHOR)[0]) in " ".join(readings(text)[0])


def test_a_hyphen_at_a_line_end_has_both_readings():
    assert readings("a well-\nknown thing") == [["a", "wellknown", "thing"], ["a", "well", "known", "thing"]]


def test_hyphens_within_reach_are_read_in_all_ways():
    from itertools import product

    divided = "a well-\nknown inter-\nnational and long-\nterm plan"
    want = {f"a well{x}known inter{y}national and long{z}term plan" for x, y, z in product(["", " "], repeat=3)}
    assert want <= {" ".join(r) for r in readings(divided)}
    filler = " ".join(f"w{i}" for i in range(20))
    assert len(readings(f"well-\nknown {filler} inter-\nnational")) == 2  # too far apart for one span


def test_a_span_with_both_kinds_of_hyphens_is_found(spark):
    passage = "the well known method of international trade in grain rests on many long term contracts"
    text = "Intro words here. The well-\nknown method of inter-\nnational trade in grain rests on many long-\nterm contracts. And more text follows here."
    docs = spark.createDataFrame([(1, text), (2, text.replace("\n", ""))], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, anchor string")
    assert [tuple(r) for r in find_leaks(docs, "doc_id", "text", items, "item_id", ["anchor"]).collect()] == [(7, 1)]


@pytest.mark.parametrize("limit", [leaks.BROADCAST_BYTES, 0])
def test_equal_to_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_BYTES", limit)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 25))), None if i % 4 else " ".join(rng.choice(words) for _ in range(15)), "a") for i in range(20)]
    items += [(50, items[0][1], None, "a"), (51, "", None, "a"), (None, items[0][1], None, "a")]
    docs = []
    for i in range(200):
        w = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        source = rng.choice(items[:20])[1].split()
        take = rng.randint(9, 14)
        at = rng.randint(0, max(0, len(source) - take))
        docs.append((i, " ".join(w[:20] + source[at : at + take] + w[20:]), 1))
    docs += [(300, None, 1), (301, "", 1), (302, items[0][1], 1), (302, items[0][1], 1)]
    got = sorted(tuple(r) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string, h long"), "doc_id", "text", spark.createDataFrame(items, "item_id long, question string, anchor string, text string"), "item_id", ["question", "anchor"]).collect())
    grams = lambda t: {tuple(t.split()[j : j + 12]) for j in range(len((t or "").split()) - 11)}
    want = sorted({(i, d) for i, q, a, _ in items if i is not None for d, t, _ in docs if t and grams(t) & (grams(q) | (grams(a) if a else set()))})
    assert got == want


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, ANCHOR)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ANCHOR)], "item_id long, anchor string")
    assert find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", ["anchor"]).count() == 0
    assert find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", ["anchor"]).count() == 0
    assert find_leaks(docs, "doc_id", "text", items, "item_id", ["anchor"]).count() == 1
