"""The gap tree against brute force, in any slices."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.operators import sessions as S


def cut(times, gap):
    out, start = [], 0
    for i in range(1, len(times) + 1):
        if i == len(times) or times[i] - times[i - 1] > gap:
            out.append((start, i - 1))
            start = i
    return out


def tree(times, chunks):
    """Build by chunks: each leaves its open blocks, which are merged like the operator does."""
    events = [(t, str(i), t, str(i), 1, -1) for i, t in enumerate(times)]
    edges = sorted({0, len(events), *chunks})
    nodes, blocks = [], []
    for lo, hi in zip(edges, edges[1:]):
        got, rest = S.build(events[lo:hi], True, True)
        nodes += got
        blocks += rest
    return nodes + S.build(blocks, False, False)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_every_threshold_from_one_tree(gaps, chunks):
    times, t = [], 0
    for g in gaps:
        t += g
        times.append(t)
    nodes = tree(times, [c for c in chunks if c <= len(times)])
    for gap in range(0, 13):
        found = sorted((int(b[1]), int(b[3])) for b, around in nodes if b[5] <= gap < around)
        assert found == cut(times, gap)
        assert all(b[4] == int(b[3]) - int(b[1]) + 1 for b, _ in nodes)


def frame(spark, rows):
    return spark.createDataFrame(rows, "user string, at timestamp_ntz, id string, entity string, n long")


def test_hot_user_nulls_ties_and_clashing_names(spark):
    base = dt.datetime(2024, 3, 10, 1, 0)
    rng = random.Random(3)
    rows = [("hot", base + dt.timedelta(seconds=rng.randint(0, 200_000)), f"e{i:04}", "x", 1) for i in range(3000)]
    rows += [("one", base, "a", "x", 1), ("tie", base, "b", "x", 1), ("tie", base, "a", "x", 1), (None, base, "c", "x", 1), ("none", None, "d", "x", 1), ("dup", base, "z", "x", 1), ("dup", base, "z", "x", 1)]
    df = frame(spark, rows).repartition(7)
    got = {(r.entity, r.first_id, r.last_id, r.events) for r in S.sessions(S.gap_tree(df, F.col("user"), F.col("at"), F.col("id")), 60).collect()}
    want = set()
    for user in ("hot", "one", "tie", "dup"):
        mine = sorted((r[1], r[2]) for r in rows if r[0] == user and r[1])
        seconds = [int((t - base).total_seconds()) for t, _ in mine]
        want |= {(user, mine[a][1], mine[z][1], z - a + 1) for a, z in cut(seconds, 60)}
    assert got == want


def test_empty(spark):
    df = frame(spark, [])
    assert S.sessions(S.gap_tree(df, F.col("user"), F.col("at"), F.col("id")), 60).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zone_of_the_session_does_not_matter(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("u", dt.datetime(2024, 3, 10, 1, 55), "a", "x", 1), ("u", dt.datetime(2024, 3, 10, 3, 5), "b", "x", 1)]
        got = S.sessions(S.gap_tree(frame(spark, rows), F.col("user"), F.col("at"), F.col("id")), 15 * 60).collect()
        assert len(got) == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
