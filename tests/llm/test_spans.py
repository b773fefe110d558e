"""Shared spans against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm import spans
from groundwork.llm.fmindex import Bits, FMIndex, WaveletMatrix
from groundwork.llm.spans import segments, shared_spans


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_rank(symbols):
    s = np.asarray(symbols)
    m = WaveletMatrix(s)
    for c in range(int(s.max()) + 1):
        at = np.arange(len(s) + 1)
        assert m.rank(np.full(len(at), c), at).tolist() == [int((s[:i] == c).sum()) for i in at]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=300))
def test_neighbours(bits):
    bits[0] = True
    b = Bits(np.asarray(bits)).with_neighbours()
    at = np.arange(len(bits))
    assert b.last_up_to(at).tolist() == [max(j for j in range(i + 1) if bits[j]) for i in at]
    assert b.first_behind(at, len(bits)).tolist() == [min((j for j in range(i + 1, len(bits)) if bits[j]), default=len(bits)) for i in at]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé", min_size=1, max_size=30), st.integers(0, 3), st.booleans()), min_size=1, max_size=6), st.sampled_from([4, 5, 7, 8, 12]))
def test_matching_finds_every_stretch_of_several_owners(rows, span):
    rows = list({t: (t, o, m) for t, o, m in rows}.values())
    texts, owner, several = [r[0] for r in rows], np.asarray([r[1] for r in rows]), np.asarray([r[2] for r in rows])
    text, start = FMIndex(texts, span, owner, several).matching()
    owners = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - span + 1):
            owners.setdefault(t[i : i + span], set()).update([owner[k], *([-1 - k] if several[k] else [])])
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - span + 1) if len(owners[t[i : i + span]]) > 1}
    assert set(zip(text.tolist(), start.tolist(), strict=True)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=120), max_size=5), st.sampled_from([16, 1000]))
def test_segments_cover_every_start_once(texts, portion):
    starts = [(r, i) for part in segments(texts, 8, portion) for r, a, z in zip(*(x.tolist() for x in part[:3]), strict=True) for i in range(a, z)]
    assert starts == [(r, i) for r, t in enumerate(texts) for i in range(max(0, len(t) - 7))]


def test_equal_stretches_have_equal_routes():
    text = "the quick brown fox jumps over the lazy dog again and again"
    route = lambda t: {i: h for _, first, end, hashes in segments([t], 20) for a, z, h in zip(first, end, hashes, strict=True) for i in range(a, z)}
    plain, shifted = route(text), route("xyz " + text)
    assert all(shifted[i + 4] == h for i, h in plain.items())


def brute(records, span):
    grams = {}
    for key, t in records.items():
        for i in range(len(t or "") - span + 1):
            grams.setdefault(t[i : i + span], set()).add(key)
    out = set()
    for key, t in records.items():
        marks = [False] * len(t or "")
        for i in range(len(t or "") - span + 1):
            if len(grams[t[i : i + span]]) > 1:
                marks[i : i + span] = [True] * span
        i = 0
        while i < len(marks):
            j = i
            while j < len(marks) and marks[j]:
                j += 1
            if j > i:
                out.add((*key, i, j - i))
            i = j + 1
    return out


def found(spark, rows, span=12, **options):
    df = spark.createDataFrame(rows, "src string, id long, t string, rid string, h int")
    return {tuple(r) for r in shared_spans(df, ["src", "id"], "t", span, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"shard_characters": 300}, {"hot": 3, "shard_characters": 500}])
def test_spans_equal_brute_force(spark, options):
    rng = random.Random(7)
    boiler = "terms and conditions apply 🙂 "
    records = {}
    for i in range(60):
        body = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60)))
        records["a" if i % 2 else "b", i] = body + (boiler if i % 3 == 0 else "") + "".join(rng.choice("xyz") for _ in range(20)) + (boiler[:14] if i % 7 == 0 else "")
    records["a", 100] = "zq" * 40  # repeats itself, which shares nothing
    records["b", 101] = records["a", 1]
    rows = [(*k, t, "clash", 1) for k, t in records.items()] + [("a", 100, "zq" * 40, "again", 1), ("n", 1, None, "", 1), ("e", 1, "", "", 1)]
    assert found(spark, rows, **options) == brute(records, 12)


def test_records_with_an_equal_hash_are_kept_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(spans, "record_hashes", lambda keys: [F.lit(7).cast("long"), F.xxhash64(*keys)])
    records = {("a", i): "".join(random.Random(i % 5).choice("abcd") for _ in range(30)) for i in range(20)}
    assert found(spark, [(*k, t, "", 0) for k, t in records.items()]) == brute(records, 12)


def test_null_keys_are_keys(spark):
    text = "the same text stands in both of them"
    rows = [(None, 1, text, "", 0), ("a", None, text, "", 0)]
    assert found(spark, rows) == {(None, 1, 0, len(text)), ("a", None, 0, len(text))}


def test_one_record_repeated_many_times_shares_nothing(spark):
    rows = [("a", 1, "abcdefghijklmnopqrstuvwxyz", "", i) for i in range(3000)]
    assert found(spark, rows) == set()
    assert found(spark, [*rows, ("b", 1, "..abcdefghijklm..", "", 0)]) == {("a", 1, 0, 13), ("b", 1, 2, 13)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "src string, id long, t string")
    assert shared_spans(df, ["src", "id"], "t").count() == 0


def test_very_long_text(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    rows = [("a", 1, long, "", 0), ("a", 2, "start " + long[30_000:30_200] + " end", "", 0)]
    assert found(spark, rows, 80) == brute({("a", 1): long, ("a", 2): rows[1][2]}, 80)
