"""Long exact spans that stand in more than one record.

Every stretch of ``span`` characters is sent to a shard that its own characters choose: by the least hash among its grams of
half that length. So equal stretches meet in one shard, wherever they stand, and records needn't be compared with each other.
Successive stretches of a record with the same gram travel together, as one segment. Grams of only one record can't hold
anything shared and go no further; equal segments travel once, with the least and greatest of their records.

Each shard builds a compressed FM-index over its segments and streams them through it: backward search over a wavelet matrix
gives matching statistics up to span, and a stretch is reported if the rows it comes to belong to more than one record. A
gram that overly many segments share would make one shard too large; its segments are sent stretch by stretch instead, each
by its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.fmindex import FMIndex
from groundwork.runtime import bounded_batches, broadcast_if_small, durable, release

SPAN = 80
#: Characters of a shard, on average.
SHARD_CHARACTERS = 1_500_000
#: A gram in more segments than this is split by stretch.
HOT_SEGMENTS = 2_000
#: Characters that a worker takes apart at a time.
PORTION = 1 << 20


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram, by doubling."""
    h, size = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    h ^= h >> np.uint64(29)
    while size < gram:
        more = min(size, gram - size)
        n = len(h) - more
        h = h[:n] * np.uint64(0xD6E8FEB86659FD93) + (h[more : more + n] ^ (h[more : more + n] >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
        size += more
    return h ^ (h >> np.uint64(32))


def _portions(texts: list[str], span: int, portion: int) -> Iterator[list[tuple[int, int, str]]]:
    """(row, offset, part) in lists of about portion characters; longer texts in parts that have span - 1 characters in common."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - span + 1), portion):
            part = text[offset : offset + portion + span - 1] if len(text) > portion else text
            held.append((row, offset, part))
            size += len(part)
            if size >= portion:
                yield held
                held, size = [], 0
    if held:
        yield held


def segments(texts: list[str], span: int, portion: int = PORTION) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first start, end of starts, hash) by portion: successive stretches of span characters whose least grams are equal."""
    gram = span // 2
    for parts in _portions([t if len(t) >= span else "" for t in texts], span, portion):
        parts = [p for p in parts if p[2]]
        codes = np.frombuffer("".join(p[2] for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            continue
        sizes = np.fromiter((len(p[2]) for p in parts), np.int64, len(parts))
        least = gram_hashes(codes, gram)
        size, width = 1, span - gram + 1
        while size < width:
            more = min(size, width - size)
            least, size = np.minimum(least[:-more], least[more:]), size + more
        part = np.repeat(np.arange(len(parts)), sizes)[: len(least)]
        at = np.arange(len(least)) - (np.cumsum(sizes) - sizes)[part]
        inside = np.flatnonzero(at + span <= sizes[part])
        part, at, least = part[inside], at[inside], least[inside]
        new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (least[1:] != least[:-1])]))
        last = np.append(new[1:], len(part)) - 1
        row = np.fromiter((p[0] for p in parts), np.int64, len(parts))[part[new]]
        offset = np.fromiter((p[1] for p in parts), np.int64, len(parts))[part[new]]
        yield row, at[new] + offset, at[last] + 1 + offset, least[new].view(np.int64)


def _spans_of(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, a, z, h in segments(batch.column(2).to_pylist(), span):
            taken = pa.array(row)
            parts = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(h, pa.int64())]
            yield pa.RecordBatch.from_arrays(parts, ["r1", "r2", "a", "z", "h"])


def _pieces(batches: Iterator[pa.RecordBatch], span: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of keys, r1, r2, text and cuts as the pieces that are sent to shards: where each begins, its digest and text."""
    schema = [*names, "start", "k1", "k2", "route", "seg"]

    def made(batch: pa.RecordBatch, rows: list, starts: list, routes: list, segs: list) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.encode()) for s in segs), np.int64).reshape(-1, 2)
        routes = [k if r is None else r for r, k in zip(routes, digests[:, 0].tolist(), strict=True)]
        taken = pa.array(rows, pa.int64())
        columns = [batch.column(i).take(taken) for i in range(len(names))]
        columns += [pa.array(starts, pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(routes, pa.int64()), pa.array(segs, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema)

    for batch in batches:
        rows, starts, routes, segs, size = [], [], [], [], 0
        for row, (text, cuts) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
            for cut in cuts:
                a, z, route = cut["a"], cut["z"], cut["h"]
                for first, end in ((i, i + 1) for i in range(a, z)) if cut["hot"] else ((a, z),):
                    rows.append(row)
                    starts.append(first)
                    routes.append(None if cut["hot"] else route)
                    segs.append(text[first : end + span - 1])
                    size += len(segs[-1])
                if size >= PORTION:
                    yield made(batch, rows, starts, routes, segs)
                    rows, starts, routes, segs, size = [], [], [], [], 0
        yield made(batch, rows, starts, routes, segs)


def _shard(group: pd.DataFrame, span: int) -> pd.DataFrame:
    """Digests and intervals of shared characters, of one shard's distinct segments."""
    several = ((group["low1"] != group["high1"]) | (group["low2"] != group["high2"])).to_numpy()
    owner = pd.MultiIndex.from_arrays([group["low1"], group["low2"]]).factorize()[0]
    text, start = FMIndex(group["seg"].tolist(), span, owner, several).matching()
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    at = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)])) if len(text) else text
    last = np.append(at[1:], len(text)) - 1 if len(text) else text
    rows = text[at]
    return pd.DataFrame({"k1": group["k1"].to_numpy()[rows], "k2": group["k2"].to_numpy()[rows], "s": start[at].astype(np.int32), "e": (start[last] + span).astype(np.int32)})


def record_hashes(keys: list[str]) -> list[Column]:
    """128 bits of a record's keys in two numbers; null keys are told apart from all others."""
    parts = [c for k in keys for c in (F.col(k), F.col(k).isNull())]
    return [F.xxhash64(F.lit(0), *parts), F.xxhash64(F.lit(1), *reversed(parts))]


def shared_spans(texts: DataFrame, keys: list[str], text: str, span: int = SPAN, shard_characters: int = SHARD_CHARACTERS, hot: int = HOT_SEGMENTS) -> DataFrame:
    """keys, ``span_start`` and ``span_len`` of every maximal run of shared characters, in code points from 0.

    A character is shared if it lies in a stretch of at least span characters, exactly as stored, that also stands in a row
    with other keys. Rows with the same keys are one record and have the same text; their repetition shares nothing. Null
    and shorter texts have no run; null keys are keys like others. Columns beside keys and text are dropped, and an empty
    table gives an empty one. Records are told apart by 128 bits of their keys' hashes, and none is left out for equal ones.
    """
    if span < 4:
        raise ValueError("span must be at least 4")
    bounded_batches(texts.sparkSession)
    names = [f"g{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{n} {texts.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))
    rows = texts.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).cast("string").alias("t")).where(F.length("t") >= span)
    r1, r2 = record_hashes(names)
    rows = rows.withColumn("r1", r1).withColumn("r2", r2)
    spans = durable(rows.select("r1", "r2", "t").mapInArrow(lambda batches: _spans_of(batches, span), "r1 long, r2 long, a int, z int, h long"))
    bounds = [f(f"r{i}").alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in (1, 2)]
    grams = spans.groupBy("h").agg(*bounds, F.count("*").alias("n")).where("low1 != high1 or low2 != high2")
    grams = durable(grams.select("h", (F.col("n") > hot).alias("hot")))
    open_spans = spans.join(broadcast_if_small(grams), "h")
    cut = durable(open_spans.groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "z", "h", "hot")).alias("cuts")))
    length = f"aggregate(cuts, 0L, (n, c) -> n + if(c.hot, (c.z - c.a) * {span}L, c.z - c.a + {span}L))"
    size = cut.agg(F.sum(F.expr(length)).alias("n")).first()["n"] or 0
    release(spans, grams)
    # one row per record, and the cuts come to it: texts are shuffled once
    record = rows.groupBy("r1", "r2").agg(F.first(F.struct(*names, "t")).alias("x"))
    whole = record.join(cut, ["r1", "r2"]).select(*[f"x.{n}" for n in names], "r1", "r2", "x.t", "cuts")
    columns = [*names, "r1", "r2"]
    pieces = durable(whole.mapInArrow(lambda batches: _pieces(batches, span, columns), f"{kinds}, r1 long, r2 long, start int, k1 long, k2 long, route long, seg string"))
    release(cut)
    shards = max(1, -(-size // shard_characters))
    distinct = pieces.groupBy(F.pmod(F.col("route"), F.lit(shards)).alias("shard"), "k1", "k2").agg(F.first("seg").alias("seg"), *bounds)
    found = durable(distinct.groupBy("shard").applyInPandas(lambda g: _shard(g, span), "k1 long, k2 long, s int, e int"))
    at = pieces.select(*names, "start", "k1", "k2").join(broadcast_if_small(found), ["k1", "k2"])
    at = at.select(*names, (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    in_order = Window.partitionBy(*names).orderBy("s", "e")
    reached = F.max("e").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    islands = at.withColumn("new", F.when(F.col("s") <= reached, 0).otherwise(1)).withColumn("island", F.sum("new").over(in_order))
    runs = islands.groupBy(*names, "island").agg(F.min("s").alias("span_start"), F.max("e").alias("e"))
    return runs.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "span_start", (F.col("e") - F.col("span_start")).alias("span_len"))
