"""Runs of identical or near-identical events in ordered sequences, by optimal segmentation.

A run costs what its events differ from the event that represents it best, plus a penalty for each boundary. The cheapest
segmentation is found by dynamic programming from left to right. A start is given up once the run from it costs no less than
the best segmentation so far: splitting never makes a run dearer, so it can't win later (pruned exact linear time). Where
runs are clear, one or two starts stay in play, and a sequence takes linear time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.runtime import durable
from groundwork.sources.tables import from_micros, micros

Distance = Callable[[str, str], float]

SCHEMA = "first_position int, last_position int, label string, events int, total_duration long"


def same(a: str, b: str) -> float:
    """Only identical labels belong to one run."""
    return 0.0 if a == b else math.inf


def edit_share(a: str, b: str) -> float:
    """Edits from one label to the other as a share of the longer one."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1] / max(len(a), len(b), 1)


def word_share(a: str, b: str) -> float:
    """The share of the two labels' words that only one of them has."""
    x, y = set(a.split()), set(b.split())
    return 1 - len(x & y) / max(len(x | y), 1)


def run_cost(labels: list[str | None], distance: Distance) -> float:
    """What the events of one run differ from their best representative; a null label only stands alone."""
    if len(labels) == 1:
        return 0.0
    if None in labels:
        return math.inf
    return min(sum(distance(x, centre) for x in labels) for centre in set(labels))


def segment(labels: list[str | None], penalty: float, distance: Distance = same) -> list[int]:
    """The starts of the cheapest runs. Among equally cheap segmentations, the one whose last run is longest, and so on."""
    best, back = [0.0], [0]
    # start -> (events by label, cost by representative)
    open_runs: dict[int, tuple[dict, dict]] = {}
    seen: dict[tuple[str, str], float] = {}

    def between(a: str, b: str) -> float:
        if a == b:
            return 0.0
        if (a, b) not in seen:
            seen[a, b] = distance(a, b)
        return seen[a, b]

    for t, label in enumerate(labels):
        open_runs[t] = ({}, {})
        least, start, costs = math.inf, t, {}
        for s, (events, by_centre) in open_runs.items():
            if s == t:
                cost = 0.0
                if label is not None:
                    events[label], by_centre[label] = 1, 0.0
            elif label is None or not events:
                cost = math.inf
            else:
                if label not in by_centre:
                    by_centre[label] = sum(n * between(x, label) for x, n in events.items())
                for centre in by_centre:
                    if centre != label:
                        by_centre[centre] += between(label, centre)
                events[label] = events.get(label, 0) + 1
                cost = min(by_centre.values())
            costs[s] = best[s] + cost
            if costs[s] + penalty < least:
                least, start = costs[s] + penalty, s
        best.append(least)
        back.append(start)
        for s, cost in costs.items():
            if cost >= least:
                del open_runs[s]
    starts, t = [], len(labels)
    while t:
        t = back[t]
        starts.append(t)
    return starts[::-1]


def _representative(labels: list[str | None], distance: Distance) -> str | None:
    if len(set(labels)) == 1:
        return labels[0]
    return min(sorted(set(labels)), key=lambda centre: sum(distance(x, centre) if x != centre else 0 for x in labels))


def collapse_runs(
    df: DataFrame,
    keys: list[str],
    labels: str,
    positions: str,
    durations: str,
    penalty: float = 0.5,
    distance: Distance = same,
) -> DataFrame:
    """keys and SCHEMA: every run of every row's sequence, single events as well, with its count and total duration.

    labels, positions and durations are array columns of one length, in order. A null label is a run of its own; durations
    that are null or negative count as nothing; a null or empty sequence has no run. Rows are sequences of their own, so
    repeated rows repeat their runs. Columns of df beside the given ones are dropped. No shuffle.
    """
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    names = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", " + SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, last, label, events, total = [], [], [], [], [], []
            sequences = zip(*[batch.column(len(names) + i).to_pylist() for i in range(3)], strict=True)
            for row, (words, places, times) in enumerate(sequences):
                if not words:
                    continue
                starts = segment(words, penalty, distance)
                for s, e in zip(starts, [*starts[1:], len(words)], strict=True):
                    rows.append(row)
                    first.append(places[s])
                    last.append(places[e - 1])
                    label.append(words[s] if e == s + 1 else _representative(words[s:e], distance))
                    events.append(e - s)
                    total.append(sum(x for x in times[s:e] if x is not None and x >= 0))
            taken = pa.array(rows, pa.int64())
            key_columns = [batch.column(i).take(taken) for i in range(len(names))]
            values = [pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(label, pa.string()), pa.array(events, pa.int32()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(key_columns + values, names + [c.split()[0] for c in SCHEMA.split(", ")])

    picked = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        F.col(labels).cast("array<string>").alias("l"),
        F.col(positions).cast("array<int>").alias("p"),
        F.col(durations).cast("array<bigint>").alias("d"),
    )
    out = picked.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *[c.split()[0] for c in SCHEMA.split(", ")])


_EVENTS = "entity string, label string, first_us long, last_us long, first_id string, events long, slice int, edge int"
_EVENT_COLUMNS = [c.split()[0] for c in _EVENTS.split(", ")]
_FIRST, _LAST = 1, 2


def _slice_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of a sorted slice of events; its first and last one are marked, as they may go on in the slices beside."""
    place, held, edge = TaskContext.get().partitionId(), None, _FIRST
    for batch in batches:
        if not len(batch):
            continue
        entity, label, us, key = (batch[c].to_numpy() for c in ("entity", "label", "us", "id"))
        known = batch["label"].notna().to_numpy()
        new = np.ones(len(batch), bool)
        new[1:] = (entity[1:] != entity[:-1]) | (label[1:] != label[:-1]) | ~known[1:]
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(batch))
        runs = [(entity[a], label[a] if known[a] else None, int(us[a]), int(us[z - 1]), key[a], int(z - a)) for a, z in zip(at, end, strict=True)]
        if held is not None:
            first = runs[0]
            if held[1] is not None and held[:2] == first[:2]:
                runs[0] = (*held[:3], first[3], held[4], held[5] + first[5])
            else:
                runs.insert(0, held)
        held = runs.pop()
        out = [(*r, place, 0) for r in runs]
        if out:
            out[0] = (*out[0][:-1], edge)
            edge = 0
        yield pd.DataFrame(out, columns=_EVENT_COLUMNS)
    if held is not None:
        yield pd.DataFrame([(*held, place, edge | _LAST)], columns=_EVENT_COLUMNS)


def _joined_edges(group: pd.DataFrame) -> pd.DataFrame:
    """Of one entity the runs at its slices' edges, two a slice at most: those that go on over an edge as one."""
    out: list[tuple] = []
    for row in group.sort_values(["slice", "edge"], kind="stable")[_EVENT_COLUMNS].itertuples(index=False, name=None):
        before = out[-1] if out else None
        if before and before[6] < row[6] and before[7] & _LAST and row[7] & _FIRST and before[1] is not None and before[1] == row[1]:
            out[-1] = (*before[:3], row[3], before[4], before[5] + row[5], *row[6:])
        else:
            out.append(row)
    return pd.DataFrame(out, columns=_EVENT_COLUMNS)


def collapse_events(df: DataFrame, entity: Column, ts: Column, event_id: Column, label: Column) -> DataFrame:
    """(entity, label, started_at, ended_at, duration_s, events): every run of successive events of an entity with one label,
    for events that are rows. Any number of events may belong to one entity.

    Events are ordered by time and id, and spread by range, so that an entity has as many tasks as its share of the rows asks
    for; only the runs at the edges of slices meet, two a slice at most. Events without entity, time or id are left out; a
    null label is a run of its own; repeated rows count each. For labels that are merely alike use collapse_runs.
    """
    keyed = df.select(entity.cast("string").alias("entity"), micros(ts).alias("us"), event_id.cast("string").alias("id"), label.cast("string").alias("label"))
    keyed = keyed.where("entity is not null and us is not null and id is not null")
    # ids as wide as they may be, so that numbers stand in their order
    order = ["entity", "us", F.length("id"), "id"]
    runs = durable(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_slice_runs, _EVENTS))
    edges = runs.where("edge > 0").groupBy("entity").applyInPandas(_joined_edges, _EVENTS)
    every = runs.where("edge = 0").unionByName(edges)
    seconds = (F.col("last_us") - F.col("first_us")) / 1e6
    return every.select("entity", "label", from_micros(F.col("first_us")).alias("started_at"), from_micros(F.col("last_us")).alias("ended_at"), seconds.alias("duration_s"), "events")
