"""Sessions by inactivity, from a Cartesian tree over the gaps between an entity's successive events.

A node of the tree is a gap; the events below it form the stretch in which no gap is larger. Cut at a threshold, the tree
leaves the stretches whose own largest gap is within the threshold while the next gap around them isn't. So each stretch is
kept as a row with both numbers, and sessions for any threshold are one filter over the same table.

Events are sorted by range of (entity, time, id), which spreads one entity over as many tasks as its share of the rows asks
for. Every task builds the trees of its slice; of an entity that reaches over its edges it leaves the blocks between the
gaps on the tree's two spines, about twice the logarithm of its rows. Those are merged per entity in a second, small step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.sources.tables import from_micros, micros

SCHEMA = "entity string, start_us long, first_id string, end_us long, last_id string, n long, gap_us long, parent_us long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_INF = 1 << 62
_SINGLE = -1

# A block is (start_us, first_id, end_us, last_id, n, gap_us): a stretch of events and the largest gap within.
Block = tuple


def _join(blocks: list[Block], gap: int) -> Block:
    return (blocks[0][0], blocks[0][1], blocks[-1][2], blocks[-1][3], sum(b[4] for b in blocks), gap)


def build(blocks: list[Block], left_open: bool, right_open: bool) -> tuple[list[tuple[Block, int]], list[Block]]:
    """The tree over successive blocks of one entity: nodes as (block, gap around it), and the blocks left open.

    An open side is one on which the entity goes on elsewhere; nodes that reach it can't be told yet.
    """
    m = len(blocks)
    gaps = [_INF] + [blocks[i][0] - blocks[i - 1][2] for i in range(1, m)] + [_INF]
    left, right, first_of_equals = [0] * m, [m] * m, [True] * m
    stack: list[int] = []
    for i in range(1, m):
        g = gaps[i]
        while stack and gaps[stack[-1]] < g:
            right[stack.pop()] = i
        if stack and gaps[stack[-1]] == g:
            left[i], first_of_equals[i] = left[stack[-1]], False
        else:
            left[i] = stack[-1] if stack else 0
        stack.append(i)
    before = [0]
    for b in blocks:
        before.append(before[-1] + b[4])
    open_ends = left_open or right_open
    spine = {i for i in range(1, m) if (left_open and left[i] == 0) or (right_open and right[i] == m)}
    edges = spine | {0, m} if open_ends else set()
    nodes: list[tuple[Block, int]] = []
    for i in range(1, m):
        lo, hi = left[i], right[i]
        if i in spine or not first_of_equals[i] or (lo in edges and hi in edges):
            continue
        a, z = blocks[lo], blocks[hi - 1]
        nodes.append(((a[0], a[1], z[2], z[3], before[hi] - before[lo], gaps[i]), min(gaps[lo], gaps[hi])))
    for i in range(m):
        if not (i in edges and i + 1 in edges):
            around = min(gaps[i], gaps[i + 1])
            if blocks[i][5] < around:
                nodes.append((blocks[i], around))
    if not open_ends:
        return nodes, []
    cuts = sorted(edges)
    rest = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = blocks[lo:hi]
        rest.append(part[0] if len(part) == 1 else _join(part, max(max(b[5] for b in part), *gaps[lo + 1 : hi])))
    return nodes, rest


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _rows(entity: str, nodes: list[tuple[Block, int]]) -> list[tuple]:
    return [(entity, *block, around) for block, around in nodes]


def _slice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted slice: nodes that are settled, with the gap around them, and open blocks, without."""
    entity, blocks, first = None, [], True
    for batch in batches:
        out: list[tuple] = []
        for row in batch.itertuples(index=False, name=None):
            if row[0] != entity:
                if entity is not None:
                    nodes, rest = build(blocks, first, False)
                    out += _rows(entity, nodes) + [(entity, *b, None) for b in rest]
                    first = False
                entity, blocks = row[0], []
            blocks.append((row[1], row[2], row[1], row[2], 1, _SINGLE))
        if entity is not None:
            nodes, blocks = build(blocks, first, True)
            out += _rows(entity, nodes)
        frame = _frame(out)
        frame["parent_us"] = frame["parent_us"].astype("Int64")
        yield frame
    if entity is not None:
        frame = _frame([(entity, *b, None) for b in blocks])
        frame["parent_us"] = frame["parent_us"].astype("Int64")
        yield frame


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["start_us", "first_id"], kind="stable")
    blocks = list(group[_COLUMNS[1:7]].itertuples(index=False, name=None))
    return _frame(_rows(group["entity"].iloc[0], build(blocks, False, False)[0]))


def gap_tree(events: DataFrame, entity: Column, ts: Column, event_id: Column) -> DataFrame:
    """The tree of every entity as rows of SCHEMA: a stretch of events, its largest gap and the smaller gap around it.

    Events with a null entity, time or id are left out; equal times are ordered by id, and repeated rows count each. An
    empty input gives an empty table. Other columns of the input don't matter. The result is computed once and kept.
    """
    from groundwork.runtime import durable

    keyed = events.select(entity.cast("string").alias("entity"), micros(ts).alias("us"), event_id.cast("string").alias("id"))
    keyed = keyed.where("entity is not null and us is not null and id is not null")
    sliced = keyed.repartitionByRange("entity", "us", "id").sortWithinPartitions("entity", "us", "id")
    level = durable(sliced.mapInPandas(_slice, SCHEMA))
    left = level.where("parent_us is null").groupBy("entity").applyInPandas(_merge, SCHEMA)
    return level.where("parent_us is not null").unionByName(left)


def sessions(tree: DataFrame, gap_seconds: float) -> DataFrame:
    """The sessions of a gap_tree for one threshold: a larger gap than it starts a new session."""
    cut = int(round(gap_seconds * 1_000_000))
    return tree.where((F.col("gap_us") <= cut) & (F.col("parent_us") > cut)).select(
        "entity",
        "first_id",
        "last_id",
        from_micros(F.col("start_us")).alias("started_at"),
        from_micros(F.col("end_us")).alias("ended_at"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"),
        F.col("n").alias("events"),
    )
