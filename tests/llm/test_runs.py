"""Segmentation against every possible one."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm.runs import collapse_runs, edit_share, run_cost, same, segment

LABELS = st.lists(st.sampled_from(["a", "b", "ab", None]), max_size=8)


def cost(labels, starts, penalty, distance):
    ends = [*starts[1:], len(labels)]
    return sum(run_cost(labels[s:e], distance) + penalty for s, e in zip(starts, ends, strict=True))


@settings(max_examples=200, deadline=None)
@given(LABELS, st.sampled_from([0.2, 0.5, 0.9]), st.sampled_from([same, edit_share]))
def test_cheapest(labels, penalty, distance):
    starts = segment(labels, penalty, distance)
    if not labels:
        assert starts == []
        return
    every = ([0, *cuts] for r in range(len(labels)) for cuts in itertools.combinations(range(1, len(labels)), r))
    assert starts[0] == 0 and cost(labels, starts, penalty, distance) == pytest.approx(min(cost(labels, list(s), penalty, distance) for s in every))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", None]), max_size=60))
def test_identical_labels_make_maximal_runs(labels):
    starts = segment(labels, 0.5)
    assert starts == [i for i, x in enumerate(labels) if i == 0 or x is None or x != labels[i - 1]]


def test_long_run_is_linear():
    assert segment(["a"] * 200_000, 0.5) == [0]


def test_rows(spark):
    rows = [
        (1, ["a", "a", "b", None, None, "a"], [1, 2, 3, 4, 5, 9], [5, None, -3, 1, 1, 2], "x"),
        (2, [], [], [], "x"), (3, None, None, None, "x"), (4, ["a"], [7], [None], "x"), (4, ["a"], [7], [None], "x"),
    ]
    df = spark.createDataFrame(rows, "id int, names array<string>, at array<int>, ms array<long>, label string")
    got = [tuple(r) for r in collapse_runs(df, ["id"], "names", "at", "ms").orderBy("id", "first_position").collect()]
    assert got == [(1, 1, 2, "a", 2, 5), (1, 3, 3, "b", 1, 0), (1, 4, 4, None, 1, 1), (1, 5, 5, None, 1, 1), (1, 9, 9, "a", 1, 2), (4, 7, 7, "a", 1, 0), (4, 7, 7, "a", 1, 0)]
    assert collapse_runs(df.limit(0), ["id"], "names", "at", "ms").count() == 0


def test_near_identical_labels(spark):
    df = spark.createDataFrame([(1, ["page_1", "page_2", "page_1", "other"], [1, 2, 3, 4], [1, 1, 1, 1])], "id int, l array<string>, p array<int>, d array<long>")
    got = [(r.label, r.events) for r in collapse_runs(df, ["id"], "l", "p", "d", 0.5, edit_share).orderBy("first_position").collect()]
    assert got == [("page_1", 3), ("other", 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_events_as_rows_equal_brute_force(spark, parts):
    import random
    from itertools import groupby

    from pyspark.sql import functions as F

    from groundwork.llm.runs import collapse_events

    rng = random.Random(parts)
    rows = [(rng.choice(["u", "u", "u", "v", None]), rng.randint(0, 400), i, rng.choice("aaab") if i % 11 else None) for i in range(900)]
    rows += [("long", i, 1000 + i, "x") for i in range(500)] + [(None, 1, 5000, "x"), ("w", None, 5001, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "user string, s int, id int, kind string").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(tuple(r) for r in collapse_events(df, F.col("user"), F.col("ts"), F.col("id"), F.col("kind")).select("entity", F.unix_seconds(F.col("started_at").cast("timestamp")), "events", "duration_s", F.coalesce("label", F.lit("-"))).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    ordered = sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[:3])
    for (user, kind, _), own in groupby(ordered, key=lambda r: (r[0], r[3], r[2] if r[3] is None else -1)):
        own = list(own)
        want.append((user, own[0][1], len(own), float(own[-1][1] - own[0][1]), kind or "-"))
    assert got == sorted(want)
    assert collapse_events(df.limit(0), F.col("user"), F.col("ts"), F.col("id"), F.col("kind")).count() == 0
