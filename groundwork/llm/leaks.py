"""Evaluation passages in training texts, by winnowing.

Both sides are read as words the way a reader sees them. Of every window of successive k-grams of words, the one with the
least hash is kept, so two texts that share span words in a row share a kept k-gram: a span holds span - k + 1 k-grams, which is
one window, and equal windows keep the same. The fingerprints of both sides are joined, and each hit is extended to both
sides, word by word, as far as a span that holds the k-gram can reach; what then is as long as span is a leak.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.text import readings
from groundwork.runtime import BROADCAST_BYTES, bounded_batches, broadcast_if_small, durable

#: Words in a row that make a leak, and words of a k-gram.
SPAN = 12
GRAM = 8


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def winnow(words: list[str], gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept k-grams: of each window the rightmost with the least hash. Fewer k-grams than a
    window keep none, as no shared span fits in."""
    n = len(words) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
    h = _mixed(h)
    windows = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    kept = np.unique(np.arange(n - window + 1) + window - 1 - windows.argmin(axis=1))
    return kept, h[kept].view(np.int64)


def fingerprints(df: DataFrame, key: str, texts: list[str], span: int, gram: int, only: np.ndarray | None = None) -> DataFrame:
    """(key, h, around) of every kept k-gram of the given texts: its hash, and its words with as many on both sides as a
    span that holds it can reach; beyond the text's ends these are null. only: sorted hashes, of which to keep others out."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(only) if only is not None else None
    reach, kind = span - gram, df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value if shared is not None else None
        for batch in batches:
            keys, hashes, around = [], [], []
            for k, text in zip(batch["k"], batch["t"], strict=True):
                for words in readings(text, span):
                    at, h = winnow(words, gram, span - gram + 1)
                    if wanted is not None and len(h):
                        found = np.searchsorted(wanted, h)
                        hit = wanted[np.minimum(found, len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
                        at, h = at[hit], h[hit]
                    for i, x in zip(at.tolist(), h.tolist(), strict=True):
                        lo, hi = i - reach, i + gram + reach
                        keys.append(k)
                        hashes.append(x)
                        around.append([None] * max(0, -lo) + words[max(0, lo) : hi] + [None] * max(0, hi - len(words)))
            yield pd.DataFrame({"k": pd.Series(keys, dtype=batch["k"].dtype), "h": pd.Series(hashes, dtype="int64"), "around": pd.Series(around, dtype=object)})

    texts_of = df.select(F.col(key).alias("k"), F.explode(F.array(*[F.col(t).cast("string") for t in texts])).alias("t"))
    return texts_of.where("k is not null and t is not null").mapInPandas(run, f"k {kind}, h long, around array<string>")


def find_leaks(
    documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, passages: list[str], span: int = SPAN, gram: int = GRAM
) -> DataFrame:
    """(item_key, doc_key), once each: the documents that hold span words in a row of one of an item's passages.

    Null, empty and shorter texts leak nothing, and rows with a null key are left out. Items with the same passage are all
    found. Repeated rows give one result; other columns don't matter, and an empty side gives an empty table. The items'
    hashes go to the workers if they measure less than BROADCAST_BYTES, so that only hits leave them; more items are joined
    by a shuffle on the hash.
    """
    if not 0 < gram <= span:
        raise ValueError("gram must be between 1 and span")
    tests = durable(fingerprints(items, item_key, passages, span, gram).select(F.col("k").alias("item"), "h", F.col("around").alias("expected")))
    distinct = tests.select("h").distinct()
    only = None
    if distinct.count() * 8 < BROADCAST_BYTES:
        only = np.sort(distinct.toPandas()["h"].to_numpy(np.int64))  # by Arrow, as many bytes as were counted
    found = fingerprints(documents, doc_key, [doc_text], span, gram, only)
    hits = found.join(broadcast_if_small(tests, "expected"), "h")
    reach = span - gram
    extended = f"exists(sequence(0, {reach}), s -> forall(sequence(0, {span - 1}), i -> coalesce(around[s + i] = expected[s + i], false)))"
    return hits.where(extended).select(F.col("item").alias(item_key), F.col("k").alias(doc_key)).distinct()
