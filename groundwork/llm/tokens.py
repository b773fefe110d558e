"""Encoding a corpus with a byte-level BPE vocabulary, by forced boundaries.

Byte-level BPE never makes a token that isn't in its vocabulary. So where a pair of neighbouring bytes stands inside no token
of the vocabulary, no merge crosses it, and both sides can be encoded apart. Which pairs these are is one table of 256 x 256
bits, from the vocabulary alone. A cut is made at those of them that are no less certain for the pattern which splits a text
into words before BPE (see _certain). Most fragments are then single words, encoded once and looked up afterwards.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.runtime import bounded_batches

#: Fixed value: the public splitting pattern of the 50k byte-level vocabularies, for which _certain is worked out.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments that a Python worker remembers.
REMEMBERED = 1 << 19
#: Fragments longer than this many bytes are encoded but not remembered.
REMEMBERED_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def unseen_pairs(tokens: Iterator[bytes]) -> np.ndarray:
    """bool[256, 256]: the pairs of bytes that stand inside no token."""
    unseen = np.ones((256, 256), dtype=bool)
    for token in tokens:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8)
            unseen[b[:-1], b[1:]] = False
    return unseen


def _certain() -> np.ndarray:
    """bool[256, 256]: pairs at which the pattern comes to the same words with or without a cut, if no token holds the pair.

    - Before ASCII white space, unless the byte before may end white space: no word reaches into white space after it.
    - Between ASCII characters that aren't white space, unless the second is an apostrophe after a symbol: a class of
      characters that goes on is taken up again at the cut, and the vocabulary holds the pairs of all contractions.
    A cut in or after white space would change what the pattern's look-ahead sees, so there is none.
    """
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    may_end_space = space.copy()
    may_end_space[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True  # the last bytes of white space beyond ASCII
    ascii_text = np.zeros(256, dtype=bool)
    ascii_text[33:127] = True
    alnum = np.zeros(256, dtype=bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        alnum[lo:hi] = True
    certain = ~may_end_space[:, None] & np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])[None, :]
    certain |= ascii_text[:, None] & ascii_text[None, :]
    certain[ascii_text & ~alnum, ord("'")] = False
    return certain


class Encoder:
    """Ids by vocabulary and pattern; remembers short fragments."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.bpe = tiktoken.Encoding("groundwork", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = unseen_pairs(iter(ranks)) & (_certain() if pattern == PATTERN else False)
        self.known: dict[bytes, list[int]] = {}

    def fragment(self, piece: bytes) -> list[int]:
        ids = self.bpe.encode_ordinary(piece.decode("utf-8"))
        if len(piece) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def cuts(self, data: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.cut[data[:-1], data[1:]]) + 1 if len(data) > 1 else np.zeros(0, dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self.batch(pa.array([text], pa.string())).to_pylist()[0]

    def batch(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids for each text; an empty one for an empty or null text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = raw.to_pybytes()[offsets[0] : offsets[-1]] if raw is not None else b""
        offsets = offsets - offsets[0]
        edges = np.union1d(self.cuts(np.frombuffer(data, dtype=np.uint8)), offsets)
        ends = edges.tolist()
        known, out, counts, start = self.known, [], [0], 0
        for end in ends[1:]:
            piece = data[start:end]
            ids = known.get(piece)
            out += self.fragment(piece) if ids is None else ids
            counts.append(len(out))
            start = end
        starts = np.asarray(counts)[np.searchsorted(edges, offsets)] if len(edges) else np.zeros(len(offsets), np.int64)
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.asarray(out, dtype=np.int32), pa.int32()))


def _encoder(blob: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    store = sys.modules.setdefault("_groundwork_encoders", types.ModuleType("_groundwork_encoders"))
    key = hashlib.sha256(blob + pattern.encode()).hexdigest()
    if not hasattr(store, key):
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line.strip())}
        setattr(store, key, Encoder(ranks, pattern))
    return getattr(store, key)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens, the text taken exactly as stored.

    vocabulary is the path of a file of base64 tokens and ranks; it's read by the driver and sent to the executors, a
    megabyte. A null and an empty text have an empty list; special tokens' strings are ordinary text. Repeated rows are
    encoded each; other columns are dropped. No shuffle; a text of any length is one row, in memory linear in its bytes.
    With a pattern other than PATTERN, whole texts are the fragments.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    with open(vocabulary, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(blob.value, pattern)
        for batch in batches:
            # a few megabytes of text at a time, whatever the texts' lengths
            start = 0
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + (4 << 20), side="right")))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.batch(part.column(1))], ["k", "ids"])
                start = stop

    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind.simpleString()}, ids array<int>")
    return out.select(F.col("k").alias(key), "ids")
