"""Subjects of documents, by a seeded non-negative factorisation of sentences by terms.

Each row of the matrix is a sentence, each component a subject, and one more component holds what all subjects share. The
components are anchored: a term may have a weight in a subject only if it stands with it significantly more often than chance,
first in the documents labelled by hand, then in all sentences. Given the anchors, both sides are updated alternately by the
multiplicative rule for the Kullback-Leibler divergence: a sentence's weights under the given terms, with its document's own
mixture as what goes before, and the terms' weights from the sums, over all sentences, of what each component explains of them.
That goes on until the divergence stops falling.

Anchors come from counts: for each term, the subjects of the sentences it stands in, by what the rest of the sentence says,
and of their documents, by what the other sentences say; a term must pass by both. So wrong labels, names that stand somewhere
by chance and phrases that go with each other on any subject don't anchor themselves. Counts are taken over all documents and
summed by term. Texts are split once, into numbers that stand for their terms; every pass reads those.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from groundwork.llm.text import composed, undivided, visible
from groundwork.runtime import bounded_batches, durable

#: Standard deviations above chance from which a term is anchored in a subject, and the least sentences or documents: first
#: in the labelled documents, which are few and only begin, then in each half step over all documents.
ANCHOR_Z = (2.0, 3.0, 4.0)
LEAST = (2, 3, 3)
#: How many times its rate by chance a term must have in a subject to be anchored there, and 3/4 as many times its rate outside.
LIFT = 2.0
#: Multiplicative updates of a sentence's weights.
UPDATES = 8
#: How many words a document's mixture counts for in a sentence.
PRIOR_WORDS = 0.5
#: A sentence is on a subject if at least so many of its terms are explained by it.
ON_SUBJECT = 0.5
#: A document is on a subject that this share of its sentences on any subject are about.
SHARE = 1 / 3
#: Anchored terms whose weights go to the workers by the driver; if there are more, all stay a table that is joined.
MOST_TERMS = 500_000

#: The updates end once a round lowers the divergence by less than this share of it.
TOLERANCE = 0.01
#: Characters that are taken apart, and terms that are updated, at a time.
PORTION = 500_000
#: Terms that a Python worker remembers.
REMEMBERED = 1 << 20

#: Scripts that are written without spaces between words.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Tham}\p{Tai_Viet}\p{Javanese}\p{Balinese}"
_CLOSING = r"[\"”’»)\]」』】》〉]*"
_SPACED_END = rf"(?<=[.!?…。؟۔।॥։።፧።။។]){_CLOSING}\s+|\n[ \t]*\n"
_SENTENCE = re.compile(_SPACED_END)
_TERM = re.compile(r"[^\W\d_]{2,}")
#: Texts with any of these are read by the patterns below; the first holds all blocks that may have any, and is quicker.
_MAY_BE_OTHER = re.compile("[\u02ea\u02eb\u0300-\u036f\u0483-\u0489\u0590-\u1dff\u20d0-\u20ff\u2c00-\U0010ffff]")
_OTHER = regex.compile(rf"[\p{{M}}{_UNSPACED}]")
#: Ideographic and Burmese, Khmer and Tibetan marks end a sentence without white space; so do ! and ? between characters of
#: such scripts, and white space alone does in those of them that have no mark, as Thai.
_OTHER_SENTENCE = regex.compile(
    rf"{_SPACED_END}|(?<=[。॥။។།༎]){_CLOSING}\s*|(?<=[{_UNSPACED}]{_CLOSING}[!?…]+){_CLOSING}\s*(?=[{_UNSPACED}\"“‘«(\[「『【《〈])"
    r"|(?<=[\p{Thai}\p{Lao}\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Viet}]\p{M}*)\s+(?=[\p{Thai}\p{Lao}\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Viet}])"
)
#: A word of a spaced script, or a run of one that isn't.
_OTHER_TERM = regex.compile(rf"(?P<run>[ー々{_UNSPACED}][ー々\p{{M}}{_UNSPACED}]*)|[[\p{{L}}\p{{M}}]--[ー々{_UNSPACED}]]{{2,}}", regex.V1)
_CHARACTER = regex.compile(r".\p{M}*", regex.S)


def _terms(sentence: str) -> Iterator[str]:
    """Words, and in place of words the pairs of neighbouring characters where no spaces divide them; marks go with their letter."""
    for m in _OTHER_TERM.finditer(sentence):
        if m["run"] is None:
            yield m[0]
            continue
        characters = _CHARACTER.findall(m[0])
        yield from map("".join, zip(characters, characters[1:], strict=False)) if len(characters) > 1 else characters


def sentences(text: str) -> list[list[str]]:
    """The terms of each sentence, once each in order of first use, in one case: its words, or pairs of characters in scripts without spaces."""
    seen = composed(undivided(visible(text).replace("\r", ""))).strip()
    other = not seen.isascii() and _MAY_BE_OTHER.search(seen) is not None and _OTHER.search(seen) is not None
    parts = (_OTHER_SENTENCE if other else _SENTENCE).split(seen)
    each = (_terms(s.casefold()) if other else _TERM.findall(s.casefold()) for s in parts)
    return [terms for terms in (list(dict.fromkeys(t)) for t in each) if terms]


class Numbers(dict):
    """64 bits that stand for each term; remembers some."""

    def __missing__(self, term: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[term] = xxhash.xxh64_intdigest(term) - (1 << 63)
        return found


def split_corpus(docs: DataFrame) -> DataFrame:
    """(k, d1, d2, terms, sizes) of rows (k, t): the terms of all sentences as numbers, and how many each sentence has. d1 and
    d2 stand for the text. Texts without a sentence have no row."""
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Numbers()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            start = 0
            while start < len(texts):
                rows, terms, sizes, ends, size_ends, characters = [], [], [], [0], [0], 0
                while start < len(texts) and characters < PORTION:
                    for sentence in sentences(texts[start]):
                        terms += map(known.__getitem__, sentence)
                        sizes.append(len(sentence))
                    if len(sizes) > size_ends[-1]:
                        rows.append(start)
                        ends.append(len(terms))
                        size_ends.append(len(sizes))
                    characters += len(texts[start])
                    start += 1
                taken = pa.array(rows, pa.int64())
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(np.asarray(v, t))) for e, v, t in ((ends, terms, np.int64), (size_ends, sizes, np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(i).take(taken) for i in range(3)] + lists, ["k", "d1", "d2", "terms", "sizes"])

    digests = [F.xxhash64(F.lit(i), "t").alias(f"d{i + 1}") for i in range(2)]
    return docs.select("k", *digests, "t").mapInArrow(run, f"k {kind}, d1 long, d2 long, terms array<long>, sizes array<int>")


class Portion:
    """Some documents: the sentence of each term, the document of each sentence."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        lists, sizes = batch.column("terms"), batch.column("sizes")
        self.documents = batch.num_rows
        self.terms = lists.flatten().to_numpy(zero_copy_only=False)
        self.sizes = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.document = np.repeat(np.arange(batch.num_rows), np.diff(sizes.offsets.to_numpy()))
        self.sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)

    @staticmethod
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[Portion]:
        for batch in batches:
            ends = batch.column("terms").offsets.to_numpy()[1:].astype(np.int64)
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else ends[0] - len(batch.column("terms")[0])
                stop = max(start + 1, int(np.searchsorted(ends, before + PORTION, side="right")))
                yield Portion(batch.slice(start, stop - start))
                start = stop


def _by_group(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by ascending group."""
    out = np.zeros((n, values.shape[1]))
    if len(groups):
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        out[groups[first]] = np.add.reduceat(values, first, axis=0)
    return out


class Weights:
    """Terms by components: of each anchored term its weight in every subject and in what all share."""

    def __init__(self, subjects: int, terms: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(terms)
        order = order[(weights[order] > 0).any(axis=1)]
        self.subjects, self.terms = subjects, terms[order]
        # most terms have a weight in one subject and in what all share: only those are kept
        term, self.component = np.nonzero(weights[order] > 0)
        self.weights = weights[order][term, self.component]
        self.first = np.searchsorted(term, np.arange(len(order) + 1))

    def explain(self, portion: Portion) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Places of anchored terms, what of each is explained by each component, the subjects' sums by sentence, and the
        divergence, without what doesn't depend on the factors."""
        k, n = self.subjects, len(portion.sizes)
        at = np.minimum(np.searchsorted(self.terms, portion.terms), max(len(self.terms) - 1, 0))
        place = np.flatnonzero(self.terms[at] == portion.terms) if len(self.terms) else np.zeros(0, np.int64)
        if not len(place):
            return place, np.zeros((0, k + 1)), np.zeros((n, k)), 0.0
        some, row = np.unique(portion.sentence[place], return_inverse=True)  # sentences without an anchored term are on nothing
        document, m = portion.document[some], len(some)
        # one entry for every weight of every anchored term: its term, component and weight, and its cell in the sentences' weights
        first, size = self.first[at[place]], np.diff(self.first)[at[place]]
        ends = np.cumsum(size)
        term = np.repeat(np.arange(len(place)), size)
        entry = np.arange(ends[-1]) + (first - ends + size)[term]
        component, h = self.component[entry], self.weights[entry]
        cell = row[term] * (k + 1) + component
        background = (portion.sizes[some] - np.bincount(row, minlength=m)).astype(float)
        mixture = np.full((portion.documents, k), 1 / k)
        for half in range(2):
            base = np.column_stack([PRIOR_WORDS * mixture[document] + 1e-3, background + 0.5]).ravel()
            w = base
            for _ in range(UPDATES):
                part = w[cell] * h
                part /= np.maximum(np.add.reduceat(part, ends - size), 1e-300)[term]
                told = np.bincount(cell, part, minlength=len(base))
                w = base + told
            told = told.reshape(m, k + 1)
            if half == 0:
                total = _by_group(told[:, :k], document, portion.documents) + 0.1
                mixture = total / total.sum(axis=1, keepdims=True)
        by_sentence = np.zeros((n, k))
        by_sentence[some] = told[:, :k]
        by_term = np.zeros((len(place), k + 1))
        by_term[term, component] = part
        share = w / np.repeat(w.reshape(m, k + 1).sum(axis=1), k + 1)
        divergence = -np.log(np.maximum(np.add.reduceat(share[cell] * h, ends - size), 1e-300)).sum()
        return place, by_term, by_sentence, float(divergence)


def _priors(total: Row, subjects: int) -> dict[str, np.ndarray] | None:
    """By letter the share of each subject in the counts. A lone subject has no other to be told apart from, so what is on
    none comes last, as one more. None without any count."""
    every = {letter: np.asarray([total[f"{letter}{i}"] or 0.0 for i in range(subjects)]) for letter in "cd"}
    if not every["c"].sum():
        return None
    if (every["c"] > 0).sum() == 1:
        every = {letter: np.append(v, max(total["n"] - v.sum(), 0.0)) for letter, v in every.items()}
        return {letter: v / max(v.sum(), 1e-12) for letter, v in every.items()}
    return dict.fromkeys("cd", every["c"] / every["c"].sum())


def _elsewhere(ratio: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Of every subject the (upper) median of the ratios that the others have."""
    shared = np.zeros_like(ratio)
    for i in range(ratio.shape[1]):
        others = [j for j in np.flatnonzero(prior > 0) if j != i]
        if others:
            shared[:, i] = np.sort(ratio[:, others], axis=1)[:, len(others) // 2]
    return shared


def _anchored(counted: pd.DataFrame, priors: dict[str, np.ndarray], subjects: int, least_z: float, least: int, lift: float) -> pd.DataFrame:
    """The anchored terms of counts: e0.. is what a term has beyond chance in every subject, best where it has most, chance its
    ratio by chance there, told its counts on any subject, every all. Each term is tested by itself. c0.. are the sentences that a term stands in, by the subject of the rest; d0.. the same by the rest
    of the document; n is all its sentences.

    A term that stands anywhere has about the same ratio of counts to expected counts in every subject. The median of the
    others' is what it has by chance; a subject anchors it by what goes beyond, if that is significant and if its rate in
    the subject is a multiple of that by chance and of its rate outside. Both rates are by the size of where they are
    counted, so that the multiples don't depend on how large the subject is.
    """
    kept = np.ones((len(counted), subjects), bool)
    every = np.maximum(counted["n"].to_numpy(float), 1)
    for letter in "dc":
        c = counted[[f"{letter}{i}" for i in range(subjects)]].to_numpy(float)
        told, prior = c.sum(axis=1), priors[letter]
        if len(prior) > subjects:
            c = np.column_stack([c, np.maximum(counted["n"].to_numpy(float) - told, 0)])
        total = c.sum(axis=1, keepdims=True)
        expected = np.maximum(total * prior, 1e-12)
        ratio = c / expected
        shared = _elsewhere(ratio, prior)
        outside = (total - c) / np.maximum(total * (1 - prior), 1e-12)
        z = (c - expected * np.maximum(shared, 1)) / np.sqrt(expected * (1 - prior) + 1)
        passed = (z >= least_z) & (c >= least) & (ratio >= lift * shared) & (ratio >= lift * 0.75 * outside)
        kept &= passed[:, :subjects]
    excess = np.where(kept, (c - shared * expected)[:, :subjects], 0)
    some = excess.sum(axis=1) > 0
    best = excess.argmax(axis=1)
    out = {"term": counted["term"].to_numpy()} | {f"e{i}": excess[:, i] for i in range(subjects)}
    return pd.DataFrame(out | {"best": best, "chance": shared[np.arange(len(c)), best], "told": told, "every": every})[some]


def _sums(names: list[str]) -> list:
    return [F.sum(name).alias(name) for name in names]


def _weights(passed: DataFrame, subjects: int) -> DataFrame:
    """(term, w) of the anchored terms: their weights in every subject and in what all share, to begin with."""
    # a term that is often without any other of its subject, unlike most anchored ones of it, has another use as well
    rate = F.when(F.col("chance") < 0.1, F.col("told") / F.col("every"))
    sums = [F.sum(name).alias(name) for name in [*[f"e{i}" for i in range(subjects)], "every"]]
    rows = passed.groupBy("best").agg(F.percentile_approx(rate, 0.5, 100_000).alias("usual"), *sums).collect()  # one per subject
    usual = {r["best"]: 1.0 if r["usual"] is None else r["usual"] for r in rows}
    by_subject = F.array(*[F.lit(float(max(usual.get(i, 1.0), 1e-6))) for i in range(subjects)])
    other = F.col("chance") * F.col("told") + F.greatest(F.col("every") - F.col("told") / by_subject[F.col("best")], F.lit(0.0))
    scale = [max(sum(r[f"e{i}"] for r in rows), 1e-12) for i in range(subjects)]
    parts = [*[F.col(f"e{i}") / scale[i] for i in range(subjects)], other / max(sum(r["every"] for r in rows), 1.0)]
    return passed.select("term", F.array(*parts).alias("w"))


def _table(terms: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Sums by distinct term; the null term stands for all of a portion."""
    arrays = [pa.array(np.append(terms, 0), pa.int64(), mask=np.arange(len(terms) + 1) == len(terms))]
    return pa.RecordBatch.from_arrays(arrays + [pa.array(np.asarray(v, float)) for v in columns.values()], ["term", *columns])


def _summed(codes: np.ndarray, n: int, values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(codes, values[:, i], minlength=n).astype(float) for i in range(values.shape[1])]


def _with_own(corpus: DataFrame, table: DataFrame) -> DataFrame:
    """The corpus with, beside each text, its anchored terms and their weights, joined by shuffles on the term and on the
    text; equal texts are looked up once."""
    each = corpus.select("d1", "d2", F.explode("terms").alias("term")).distinct()
    by_text = each.join(table, "term").groupBy("d1", "d2").agg(F.collect_list(F.struct("term", "w")).alias("own"))
    return corpus.join(by_text.select("d1", "d2", F.expr("own.term as own"), F.expr("flatten(own.w) as own_w")), ["d1", "d2"], "left")


def _own(batch: pa.RecordBatch, subjects: int) -> Weights:
    """The weights that the documents of a portion bring with them."""
    terms = batch.column("own").flatten().to_numpy(zero_copy_only=False)
    values = batch.column("own_w").flatten().to_numpy(zero_copy_only=False).reshape(-1, subjects + 1)
    terms, first = np.unique(terms, return_index=True)
    return Weights(subjects, terms, values[first])


class Factorisation:
    """The passes over a split corpus for one set of subjects."""

    def __init__(self, corpus: DataFrame, subjects: int) -> None:
        self.corpus, self.subjects, self.spark = corpus, subjects, corpus.sparkSession
        self.counts = [*[f"{letter}{i}" for letter in "cd" for i in range(subjects)], "n"]
        self.divergences: list[float] = []

    def fed(self, table: DataFrame) -> tuple[DataFrame, Callable]:
        """Documents for a pass, and what gives each portion of them with its weights. The weights of few terms go to the
        workers by the driver; those of more stay a table."""
        k, corpus, shared = self.subjects, self.corpus, None
        few = table.limit(MOST_TERMS + 1).toPandas()  # only to see whether they are few; more stay a table, all of them
        if len(few) <= MOST_TERMS:
            shared = self.spark.sparkContext.broadcast((k, few["term"].to_numpy(np.int64), np.asarray(few["w"].tolist(), float).reshape(-1, k + 1)))
        else:
            corpus = _with_own(corpus, table)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Portion, Weights]]:
            h = Weights(*shared.value) if shared is not None else None
            for portion in Portion.each(batches):
                yield portion, h or _own(portion.batch, k)

        return corpus, read

    def summed(self, of: DataFrame, run: Callable, names: list[str]) -> tuple[DataFrame, Row]:
        """Sums by term, and those of the null term."""
        by = durable(of.mapInArrow(run, "term long, " + ", ".join(f"{n} double" for n in names)).groupBy("term").agg(*_sums(names)))
        return by.where("term is not null"), by.where("term is null").agg(*_sums(names)).first()

    def labelled(self, of: DataFrame) -> tuple[DataFrame, Row]:
        """Counts of terms in documents by their given subjects (column s, null for none)."""
        k, names = self.subjects, self.counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for portion in Portion.each(batches):
                given = portion.batch.column("s")
                share = np.zeros((portion.documents, k))
                document = np.repeat(np.arange(portion.documents), given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                np.add.at(share, (document, given.flatten().to_numpy(zero_copy_only=False)), 1)
                share /= np.maximum(share.sum(axis=1, keepdims=True), 1)
                # each term once in a document
                pairs = np.unique(np.stack([portion.document[portion.sentence], portion.terms]), axis=1)
                terms, codes = np.unique(pairs[1], return_inverse=True)
                by = [np.append(v, s) for v, s in zip(_summed(codes, len(terms), share[pairs[0]]), share.sum(axis=0), strict=True)]
                each = np.append(np.bincount(codes, minlength=len(terms)), portion.documents)
                yield _table(terms, dict(zip(names, [*by, *by, each], strict=True)))

        return self.summed(of, run, names)

    def recounted(self, table: DataFrame) -> tuple[DataFrame, Row]:
        """Counts of terms by the subject of the rest of their sentence (c) and of the rest of their document (d)."""
        k, names = self.subjects, self.counts
        fed, read = self.fed(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for portion, h in read(batches):
                place, part, by_sentence, _ = h.explain(portion)
                on = by_sentence.max(axis=1) >= ON_SUBJECT
                subject = np.where(on, by_sentence.argmax(axis=1), -1)
                rest = subject[portion.sentence]
                without = by_sentence[portion.sentence[place]] - part[:, :k]
                rest[place] = np.where(without.max(axis=1) >= ON_SUBJECT, without.argmax(axis=1), -1) if len(place) else rest[place]
                is_on = np.zeros((len(subject), k))
                is_on[np.flatnonzero(on), subject[on]] = 1
                others = _by_group(is_on, portion.document, portion.documents)[portion.document] - is_on
                others /= np.maximum(others.sum(axis=1, keepdims=True), 1)
                terms, codes = np.unique(portion.terms, return_inverse=True)
                told = rest >= 0
                in_rest = np.bincount(codes[told] * k + rest[told], minlength=len(terms) * k).reshape(-1, k)
                c = [np.append(in_rest[:, i], s) for i, s in enumerate(is_on.sum(axis=0))]
                d = [np.append(v, s) for v, s in zip(_summed(codes, len(terms), others[portion.sentence]), others.sum(axis=0), strict=True)]
                each = np.append(np.bincount(codes, minlength=len(terms)), len(portion.sizes))
                yield _table(terms, dict(zip(names, [*c, *d, each], strict=True)))

        return self.summed(fed, run, names)

    def anchors(self, counted: DataFrame, priors: dict[str, np.ndarray], least_z: float, least: int, lift: float = LIFT) -> DataFrame:
        """(term, w) of the terms that counts anchor, with their weights to begin with."""
        k = self.subjects

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield _anchored(batch, priors, k, least_z, least, lift)

        excess = ", ".join(f"e{i} double" for i in range(k))
        passed = durable(counted.mapInPandas(test, f"term long, {excess}, best int, chance double, told double, every double"))
        return _weights(passed, k)

    def updated(self, table: DataFrame) -> tuple[DataFrame, float]:
        """One alternating round: the sentences' weights under the terms', then the terms' by the multiplicative rule, and the
        divergence that the old ones had. A weight of nothing stays so, so anchors are kept."""
        k = self.subjects
        names = [*[f"m{i}" for i in range(k + 1)], "divergence"]
        fed, read = self.fed(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for portion, h in read(batches):
                place, part, _, divergence = h.explain(portion)
                terms, codes = np.unique(portion.terms[place], return_inverse=True)
                m = [np.append(v, v.sum()) for v in _summed(codes, len(terms), part)]
                yield _table(terms, dict(zip(names, [*m, np.append(np.zeros(len(terms)), divergence)], strict=True)))

        by, total = self.summed(fed, run, names)
        # a column's scale goes with its weights in the sentences; what all share is measured against everything that is explained
        sums = [total[f"m{i}"] or 0.0 for i in range(k + 1)]
        scale = [max(v, 1e-12) for v in [*sums[:k], sum(sums)]]
        return by.select("term", F.array(*[F.col(f"m{i}") / scale[i] for i in range(k + 1)]).alias("w")), total["divergence"] or 0.0

    def settled(self, table: DataFrame) -> DataFrame:
        """Rounds until the divergence stops falling; their divergences are kept in order."""
        while True:
            after, divergence = self.updated(table)
            self.divergences.append(divergence)
            if len(self.divergences) > 1 and divergence >= (1 - TOLERANCE) * self.divergences[-2]:
                return table
            table = after


def subject_shares(
    documents: DataFrame, doc_key: str, text: str, subjects: list[str], labels: DataFrame, label_key: str, label: str
) -> DataFrame:
    """(doc_key, subject, sentences, share): of each document the sentences on each subject, and their share of those on any.

    subjects are the components' names, bounded by what a reader may tell apart. A label counts by its trimmed lower-case
    form; labels of other names, null labels, and labels of unknown or textless documents are passed over, and one given
    twice counts once. If only one subject has labels, it's told apart from the documents without any, so some must be on none.
    Null, empty and subjectless texts have no row, and with no usable label none has. Repeated documents
    have rows each. Whole texts are read; columns beside the given ones don't matter.
    """
    spark, k = documents.sparkSession, len(subjects)
    bounded_batches(spark)
    kind = documents.schema[doc_key].dataType.simpleString()
    docs = documents.select(F.col(doc_key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    position = F.array_position(F.array(*[F.lit(s.strip().lower()) for s in subjects]), F.lower(F.trim(F.col(label)))) - 1
    named = labels.select(F.col(label_key).alias("k"), position.cast("int").alias("s")).where("k is not null and s >= 0").distinct()
    given = named.groupBy("k").agg(F.collect_set("s").alias("s"))

    corpus = durable(split_corpus(docs))
    f = Factorisation(corpus, k)
    lift = LIFT
    by, total = f.labelled(corpus.join(given, "k"))
    priors = _priors(total, k)
    if priors is not None and len(priors["c"]) > k:
        # a lone subject begins with what its labelled documents have beyond all the others; these may be on it as well, so by any multiple
        by, total = f.labelled(corpus.join(given, "k", "left"))
        priors, lift = _priors(total, k), 0.0
    if priors is None:
        return spark.createDataFrame([], f"{doc_key} {kind}, subject string, sentences long, share double")
    table = f.anchors(by, priors, ANCHOR_Z[0], LEAST[0], lift)
    for least_z, least in zip(ANCHOR_Z[1:], LEAST[1:], strict=True):
        by, total = f.recounted(table)
        priors = _priors(total, k)
        if priors is not None:
            table = f.anchors(by, priors, least_z, least)
    fed, read = f.fed(f.settled(table))
    names = np.asarray(subjects, dtype=object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion, h in read(batches):
            by_sentence = h.explain(portion)[2]
            on = np.flatnonzero(by_sentence.max(axis=1) >= ON_SUBJECT)
            counts = np.zeros((portion.documents, k), np.int64)
            np.add.at(counts, (portion.document[on], by_sentence[on].argmax(axis=1)), 1)
            d, s = np.nonzero(counts)
            share = counts[d, s] / counts.sum(axis=1)[d]
            key = portion.batch.column("k").take(pa.array(d))
            yield pa.RecordBatch.from_arrays([key, pa.array(names[s], pa.string()), pa.array(counts[d, s]), pa.array(share)], ["k", "subject", "sentences", "share"])

    out = fed.mapInArrow(assign, f"k {kind}, subject string, sentences long, share double")
    return out.select(F.col("k").alias(doc_key), "subject", "sentences", "share")


def found_subjects(shares: DataFrame, share: float = SHARE) -> DataFrame:
    return shares.where(F.col("share") >= share - 1e-9)
