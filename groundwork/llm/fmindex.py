"""A compressed FM-index over a collection of texts: the Burrows-Wheeler transform of their concatenation as a wavelet matrix
of packed bits, and three packed bits a row for what the rows' texts have in common. Searched backwards for many texts at once.

The suffixes' order is needed only while the index is built. What stays is levels + 3 bits a symbol and small counts by word.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """Packed bits with their ranks, and the nearest one to each side of a place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.counts[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.counts[word] + np.bitwise_count(self.words[word] & below)

    def with_neighbours(self) -> Bits:
        """Also keeps, by word, the nearest other word with a one to each side."""
        some = np.flatnonzero(self.words)
        at = np.arange(len(self.words))
        k = np.searchsorted(some, at)
        self.left = np.where(k > 0, some[np.maximum(k - 1, 0)], 0).astype(np.int32) if len(some) else np.zeros(len(at), np.int32)
        k = np.searchsorted(some, at, side="right")
        self.right = np.where(k < len(some), some[np.minimum(k, len(some) - 1)], 0).astype(np.int32) if len(some) else np.zeros(len(at), np.int32)
        return self

    def last_up_to(self, at: np.ndarray) -> np.ndarray:
        """The place of the last one that doesn't stand behind each place; there must be one."""
        word = at >> 6
        masked = self.words[word] & (~np.uint64(0) >> (np.uint64(63) - (at & 63).astype(np.uint64)))
        none = masked == 0
        word = np.where(none, self.left[word], word)
        return (word << 6) + _highest(np.where(none, self.words[word], masked))

    def first_behind(self, at: np.ndarray, end: int) -> np.ndarray:
        """The place of the first one behind each place; end if there is none."""
        word = at >> 6
        masked = self.words[word] & ~(~np.uint64(0) >> (np.uint64(63) - (at & 63).astype(np.uint64)))
        none = masked == 0
        word = np.where(none, self.right[word], word)
        found = np.where(none, self.words[word], masked)
        place = (word << 6) + np.bitwise_count((found & (~found + _ONE)) - _ONE)
        return np.where((found == 0) | (place <= at), end, place)


def _highest(words: np.ndarray) -> np.ndarray:
    """The place of each word's highest one."""
    for shift in (1, 2, 4, 8, 16, 32):
        words = words | (words >> np.uint64(shift))
    return np.bitwise_count(words).astype(np.int64) - 1


class WaveletMatrix:
    """Symbols below 2**levels in n * levels bits and counts per 64 of them; ranks for arrays of symbols and positions."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.planes, self.zeros = [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            order = ((current >> level) & 1).astype(bool)
            self.planes.append(Bits(order))
            self.zeros.append(len(order) - int(np.count_nonzero(order)))
            current = np.concatenate([current[~order], current[order]])
        self.first = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, plane in enumerate(self.planes):
            ones = plane.rank(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.first[symbol]


def _sorted(body: np.ndarray, width: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, apart): suffixes in order of their first span symbols, and of each whether it differs from the one before within
    the first span - 1. body: symbols of width bits, a lowest one at the end."""
    n = len(body)

    def behind(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, values.dtype)
        out[: max(0, n - by)] = values[by:]
        return out

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], np.cumsum(ordered[1:] != ordered[:-1]) + 1])
        return rank

    # as many symbols as 62 bits hold make the first key; then every sort doubles what is told apart
    key, depth = body.astype(np.int64), 1
    while depth * 2 <= span - 1 and depth * 2 * width <= 62:
        key = (key << (depth * width)) | behind(key, depth)
        depth *= 2
    rank = ranked(key)
    while depth * 2 <= span - 1:
        rank = ranked(rank * (n + 1) + behind(rank, depth))
        depth *= 2
    order = np.argsort(rank * (n + 1) + behind(rank, span - depth))
    first, second = rank[order], behind(rank, span - 1 - depth)[order]
    return order, np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])


class FMIndex:
    """texts, indexed for patterns of up to ``span`` symbols. owner: who each text belongs to; several: which texts belong to
    more than that one.

    Suffixes are sorted by their first span symbols, which is what patterns of that length can tell apart.
    """

    def __init__(self, texts: list[str], span: int, owner: np.ndarray | None = None, several: np.ndarray | None = None) -> None:
        joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        owner = np.arange(len(texts)) if owner is None else owner
        several = np.zeros(len(texts), bool) if several is None else several
        self.span, self.lengths = span, lengths
        self.alphabet = np.unique(joined)
        self.rows = len(joined) + len(texts) + 1
        width = (len(self.alphabet) + 1).bit_length()
        # 0 ends everything, 1 ends a text
        body = np.ones(self.rows, np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32)
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        inside = np.ones(self.rows, bool)
        inside[self.starts + lengths] = False
        inside[-1] = False
        body[inside] = np.searchsorted(self.alphabet, joined) + 2
        body[-1] = 0
        self.body = body  # the texts that are streamed; the index doesn't need them
        order, apart = _sorted(body, width, span)
        text = np.append(np.repeat(np.arange(len(texts)), lengths + 1), -1)[order]
        self.apart = Bits(apart).with_neighbours()
        who = np.where(text >= 0, owner[text] if len(texts) else 0, -1)
        self.turns = Bits(np.concatenate([[False], who[1:] != who[:-1]]))
        self.several = Bits((text >= 0) & (several[text] if len(texts) else False))
        self.matrix = WaveletMatrix(body[order - 1])
        counts = np.bincount(body, minlength=1 << self.matrix.levels)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the rows of the symbol followed by what the rows from lo to hi begin with."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.before[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def widened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share span - 1 symbols with the row lo."""
        return self.apart.last_up_to(lo), self.apart.first_behind(lo, self.rows)

    def common(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the rows from lo to hi belong to more than one owner."""
        many = self.several.rank(hi) > self.several.rank(lo)
        return many | ((hi > lo + 1) & (self.turns.rank(hi) > self.turns.rank(np.minimum(lo + 1, hi))))

    def matching(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the texts, streamed from their ends: (text, start) of every stretch of span symbols that more than one owner has.

        This is the matching statistic cut at span. A text is read from right to left with the rows that begin with what
        was read. Once span symbols are matched, the last is dropped: the rows widen to those that share one symbol less,
        so each further symbol takes one step.
        """
        lanes = np.flatnonzero(self.lengths >= self.span)
        lanes = lanes[np.argsort(-self.lengths[lanes], kind="stable")]
        lengths, base = self.lengths[lanes], self.starts[lanes]
        lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.rows, np.int64)
        texts, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in range(int(lengths[0]) if len(lanes) else 0):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # lanes longer than t, which come first
            at = lengths[:live] - 1 - t
            lo[:live], hi[:live] = self.step(self.body[base[:live] + at].astype(np.int64), lo[:live], hi[:live])
            if t >= self.span - 1:
                hit = self.common(lo[:live], hi[:live])
                texts.append(lanes[:live][hit])
                starts.append(at[hit])
                lo[:live], hi[:live] = self.widened(lo[:live])
        return np.concatenate(texts), np.concatenate(starts)
