"""A set of questions against a whole corpus, in blocks: dense, lexical and fused ranks without a row for every pair.

Documents are packed once, each with its sparse vector and its counts of the terms that are asked for. A block of them is two
matrix products with the questions, in Python by Arrow batches; only what may still win leaves it. The questions' side is a
matrix whose size is checked: more questions than fit go in several rounds.

Fused ranks are cut exactly. With reciprocal ranks, a document that is among the first R of neither side can't reach the k-th
best, if R is chosen by their weights (see depth). Of the others the rank on their weaker side may lie beyond R: a second pass
counts, block by block, how many documents stand before each, for those that may still be among the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.plans import retrieval as R
from groundwork.plans.retrieval import DIMENSIONS, K1, B
from groundwork.runtime import BROADCAST_BYTES, bounded_batches, broadcast_if_small, durable, release

#: Documents of a block.
BLOCK = 2000


def depth(most: int, weights: tuple[float, float]) -> int:
    """How far both rankings must be known, so that no other document can be among the best most.

    If the stronger side ranks most documents, the last of these has its weight / (RRF + most) at least, and a document beyond
    place R of both has less than the sum of weights / (RRF + R). If it ranks fewer, they're all known, and the rest only
    compete on the other side, where place most is before R.
    """
    return max(most, math.ceil((R.RRF + most) * sum(weights) / max(weights)) - R.RRF)


class Asked(NamedTuple):
    """The questions' side of the products: keys, vectors, and the weights of terms, one column per question; the corpus' mean length;
    and how many distinct terms each question has."""

    keys: np.ndarray
    dense: np.ndarray
    lexical: np.ndarray
    mean_length: float
    terms: np.ndarray


def packed(corpus: DataFrame, key: str, text: str, terms: DataFrame, dense: bool = True) -> DataFrame:
    """(key, places, weights, terms, counts, length, distinct) of every text that isn't null: its sparse vector, if dense, its counts
    of the given terms (term, id), and how many tokens and distinct ones it has."""
    tokenised = corpus.where(F.col(text).isNotNull()).select(key, F.expr(T.tokens(text)).alias("t"))
    counts = tokenised.select(key, F.explode("t").alias("term")).join(broadcast_if_small(terms, "term"), "term").groupBy(key, "id").agg(F.count("*").alias("n"))
    counts = counts.groupBy(key).agg(F.collect_list(F.struct("id", "n")).alias("c"))
    both = tokenised.select(key, F.size("t").alias("length"), F.size(F.array_distinct("t")).alias("distinct")).join(counts, key, "left")
    if not dense:
        return both.select(key, F.expr("c.id as terms"), F.expr("c.n as counts"), "length", "distinct")
    vectors = R.embedded(corpus.where(F.col(text).isNotNull()), key, text).groupBy(key).agg(F.collect_list(F.struct("idx", "w")).alias("v"))
    both = both.join(vectors, key, "left")
    return both.select(key, F.expr("v.idx as places"), F.expr("v.w as weights"), F.expr("c.id as terms"), F.expr("c.n as counts"), "length", "distinct")


def _flat(values: pd.Series, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of lists, of which some may be null."""
    some = [(r, v) for r, v in zip(rows, values, strict=True) if v is not None and len(v)]
    if not some:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.repeat([r for r, _ in some], [len(v) for _, v in some]), np.concatenate([v for _, v in some])


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _counts(batch: pd.DataFrame, asked: Asked) -> np.ndarray:
    rows, counts = np.arange(len(batch)), np.zeros((len(batch), len(asked.lexical)))
    at, terms = _flat(batch["terms"], rows)
    counts[at, terms.astype(np.int64)] = _flat(batch["counts"], rows)[1]
    return counts


def scored(batch: pd.DataFrame, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Dense and lexical scores of a block, documents by questions."""
    rows = np.arange(len(batch))
    dense = np.zeros((len(batch), len(asked.keys)))
    if "places" in batch:
        vectors = np.zeros((len(batch), DIMENSIONS))
        at, places = _flat(batch["places"], rows)
        vectors[at, places.astype(np.int64)] = _flat(batch["weights"], rows)[1]
        dense = _rounded(vectors @ asked.dense)
    counts = _counts(batch, asked)
    length = batch["length"].to_numpy(float)[:, None]
    counts = counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / asked.mean_length))
    return dense, _rounded(counts @ asked.lexical)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            yield batch.iloc[start : start + BLOCK].reset_index(drop=True)


class Search:
    """A packed corpus with a round of questions. Documents' keys must be numbers; no two have the same."""

    def __init__(self, corpus: DataFrame, key: str, asked: Asked) -> None:
        self.corpus, self.key, self.asked = corpus, key, asked
        self.shared = corpus.sparkSession.sparkContext.broadcast(tuple(asked))

    def _run(self, emit, schema: str) -> DataFrame:  # noqa: ANN001
        shared = self.shared
        columns = [self.key, *[c for c in ("places", "weights", "terms", "counts", "length", "distinct") if c in self.corpus.columns]]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = Asked(*shared.value)
            for block in _blocks(batches):
                yield emit(block.iloc[:, 0].to_numpy(np.int64), *scored(block, asked), asked)

        return self.corpus.select(*columns).mapInPandas(run, schema)

    def best(self, most: int, sides: tuple[bool, bool] = (True, True)) -> DataFrame:
        """(q, k, dense, lexical) of documents with a positive score that are among the best most of some block by a side."""

        def emit(keys: np.ndarray, dense: np.ndarray, lexical: np.ndarray, asked: Asked) -> pd.DataFrame:
            found = []
            for use, s in zip(sides, (dense, lexical), strict=True):
                if not use:
                    continue
                # all that reach the score of place most; ties go on, and are told apart by key later
                least = np.partition(s, len(s) - most, axis=0)[len(s) - most] if len(s) > most else np.full(s.shape[1], -np.inf)
                found.append((s >= least) & (s > 0))
            d, q = np.nonzero(found[0] | found[-1])
            return pd.DataFrame({"q": asked.keys[q], "k": keys[d], "dense": dense[d, q], "lexical": lexical[d, q]})

        return self._run(emit, "q long, k long, dense double, lexical double")

    def before(self, candidates: pd.DataFrame) -> DataFrame:
        """(q, k, dense, lexical): how many documents stand before each candidate (q, k, dense, lexical) on both sides."""
        shared = self.corpus.sparkSession.sparkContext.broadcast({q: (g["k"].to_numpy(np.int64), g["dense"].to_numpy(float), g["lexical"].to_numpy(float)) for q, g in candidates.groupby("q")})

        def emit(keys: np.ndarray, dense: np.ndarray, lexical: np.ndarray, asked: Asked) -> pd.DataFrame:
            parts = []
            for i, q in enumerate(asked.keys.tolist()):
                if q in shared.value:
                    own, *limits = shared.value[q]
                    n = [((s[:, i, None] > x) | ((s[:, i, None] == x) & (keys[:, None] < own))).sum(axis=0) for s, x in zip((dense, lexical), limits, strict=True)]
                    parts.append(np.column_stack([np.full(len(own), q), own, *n]))
            rows = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
            return pd.DataFrame(rows, columns=["q", "k", "dense", "lexical"])

        each = self._run(emit, "q long, k long, dense long, lexical long")
        return each.groupBy("q", "k").agg(F.sum("dense").alias("dense"), F.sum("lexical").alias("lexical"))


def prepared(corpus: DataFrame, key: str, text: str, questions: DataFrame, question_key: str, question: str, dense: bool = True) -> tuple[DataFrame, list[Asked]]:
    """The packed corpus, kept, and the questions in rounds of bounded size."""
    bounded_batches(corpus.sparkSession)
    asked = R.terms(questions, question_key, question).select(F.col(question_key).alias("q"), "term", "qn")
    asked = durable(asked.withColumn("id", F.dense_rank().over(Window.orderBy("term")) - 1))
    docs = durable(packed(corpus, key, text, asked.select("term", "id").distinct(), dense))
    size = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    df = docs.select(F.explode("terms").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "id").select("q", "id", (F.col("qn") * idf).alias("w"))
    vectors = R.embedded(questions, question_key, question).select(F.col(question_key).alias("q"), "idx", "w")
    each = asked.groupBy("q").agg(F.max("id").alias("last"), F.count("*").alias("n")).toPandas().sort_values("q")
    keys, sizes, width, rounds = each["q"].tolist(), each["n"].to_numpy(float), int(each["last"].max() + 1) if len(each) else 0, []
    step = max(1, BROADCAST_BYTES // (8 * (R.DIMENSIONS + max(width, 1))))
    for start in range(0, len(keys), step):
        own = np.asarray(keys[start : start + step], np.int64)
        within = F.col("q").between(int(own[0]), int(own[-1]))
        places, lexical = np.zeros((R.DIMENSIONS, len(own))), np.zeros((width, len(own)))
        w = weights.where(within).toPandas()
        if dense:
            v = vectors.where(within).toPandas()
            places[v["idx"].to_numpy(np.int64), np.searchsorted(own, v["q"])] = v["w"]
        lexical[w["id"].to_numpy(np.int64), np.searchsorted(own, w["q"])] = w["w"]
        rounds.append(Asked(own, places, lexical, float(size["mean"] or 1.0), sizes[start : start + step]))
    release(asked)
    return docs, rounds


def _ranked(df: DataFrame, side: str) -> DataFrame:
    """Ranks by a side among positive scores, equal ones by key; null for the others."""
    w = Window.partitionBy("q", F.col(side) > 0).orderBy(F.desc(side), "k")
    return df.withColumn(f"{side}_rank", F.when(F.col(side) > 0, F.row_number().over(w)))


def hybrid(corpus: DataFrame, key: str, text: str, questions: DataFrame, question_key: str, question: str, most: int, weights: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """(question_key, key, score) of candidates that hold the best most documents of every question by fused reciprocal ranks of
    the dense and the lexical side, with exact scores. Keys are whole numbers; null texts are left out, and a question that shares
    nothing with any document has no row."""
    docs, rounds = prepared(corpus, key, text, questions, question_key, question)
    least, out = depth(most, weights), None
    for asked in rounds:
        search = Search(docs, key, asked)
        found = durable(_ranked(_ranked(search.best(least), "dense"), "lexical").where(f"dense_rank <= {least} or lexical_rank <= {least}"))
        # what each has for certain, and what it may have at most
        known = [F.coalesce(F.when(F.col(f"{s}_rank") <= least, w / (R.RRF + F.col(f"{s}_rank"))), F.lit(0.0)) for s, w in zip(("dense", "lexical"), weights, strict=True)]
        open_ = [F.when((F.col(s) > 0) & (F.col(f"{s}_rank") > least), w / (R.RRF + least + 1)).otherwise(0.0) for s, w in zip(("dense", "lexical"), weights, strict=True)]
        bounds = found.withColumn("low", known[0] + known[1]).withColumn("high", F.col("low") + open_[0] + open_[1])
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"), "k"))
        bounds = bounds.withColumn("bar", F.min(F.when(place <= most, F.col("low"))).over(Window.partitionBy("q")))
        few = bounds.where("high >= bar - 1e-12").select("q", "k", "dense", "lexical").toPandas()  # at most 2 least a question
        counted = search.before(few)
        scores = corpus.sparkSession.createDataFrame(few) if len(few) else bounds.select("q", "k", "dense", "lexical").limit(0)
        both = scores.join(F.broadcast(counted.select("q", "k", F.col("dense").alias("dn"), F.col("lexical").alias("ln"))), ["q", "k"])
        parts = [F.when(F.col(s) > 0, w / (R.RRF + F.col(n) + 1)).otherwise(0.0) for s, n, w in zip(("dense", "lexical"), ("dn", "ln"), weights, strict=True)]
        one = both.select(F.col("q").alias(question_key), F.col("k").alias(key), (parts[0] + parts[1]).alias("score"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return questions.select(F.col(question_key).cast("long"), F.lit(0).cast("long").alias(key), F.lit(0.0).alias("score")).limit(0)
    return out


def lexical_best(corpus: DataFrame, key: str, text: str, questions: DataFrame, question_key: str, question: str, most: int) -> DataFrame:
    """(question_key, key, score, rank): the best most documents of every question by BM25, equal ones by key."""
    docs, rounds = prepared(corpus, key, text, questions, question_key, question, dense=False)
    out = None
    for asked in rounds:
        found = Search(docs, key, asked).best(most, (False, True)).select(F.col("q").alias(question_key), F.col("k").alias(key), F.col("lexical").alias("score"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = questions.select(F.col(question_key).cast("long"), F.lit(0).cast("long").alias(key), F.lit(0.0).alias("score")).limit(0)
    return R.ranked(out, question_key, key, most)


def remembered(
    corpus: DataFrame, key: str, text: str, questions: DataFrame, question_key: str, question: str, most: int, least: float = 0.06, weights: tuple[float, float] = (0.4, 0.6)
) -> DataFrame:
    """(question_key, key, score, rank): the best most texts of every question by cosine and by the share of the shorter one's
    distinct words that both have, of at least the given score; equal ones by key."""
    docs, rounds = prepared(corpus, key, text, questions, question_key, question)
    out = None
    for asked in rounds:
        search = Search(docs, key, asked)
        shared = search.shared

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            asked = Asked(*shared.value)
            for block in _blocks(batches):
                both = (_counts(block, asked) > 0).astype(float) @ (asked.lexical > 0).astype(float)
                shorter = np.minimum(block["distinct"].to_numpy(float)[:, None], asked.terms[None, :])
                s = _rounded(weights[0] * scored(block, asked)[0] + weights[1] * (both / np.maximum(shorter, 1)))
                edge = np.partition(s, len(s) - most, axis=0)[len(s) - most] if len(s) > most else np.full(s.shape[1], -np.inf)
                d, q = np.nonzero((s >= edge) & (s >= least))
                yield pd.DataFrame({"q": asked.keys[q], "k": block.iloc[:, 0].to_numpy(np.int64)[d], "score": s[d, q]})

        found = docs.select(key, "places", "weights", "terms", "counts", "length", "distinct").mapInPandas(run, "q long, k long, score double")
        found = found.select(F.col("q").alias(question_key), F.col("k").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = questions.select(F.col(question_key).cast("long"), F.lit(0).cast("long").alias(key), F.lit(0.0).alias("score")).limit(0)
    return R.ranked(out, question_key, key, most)


def nearest(vectors: DataFrame, key: str, vector: str, group: str, asked: DataFrame, most: int) -> DataFrame:
    """(query_id, key, score, rank): for every row of asked the most nearest others of its group by cosine, equal ones by key.

    Only positive cosines of vectors of one length count; null vectors and groups are left out. asked goes to the workers in
    rounds of bounded size, and every round is one pass over vectors, of which only a block's best leave it.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    usable = f"{vector} is not null and {group} is not null"
    few = asked.where(usable).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(group).cast("string").alias("g"))
    size = few.agg(F.sum(F.size("v") * 8 + 64).alias("n")).first()["n"] or 0
    rounds, out = max(1, -(-size // BROADCAST_BYTES)), None
    rows = vectors.where(usable).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(group).cast("string").alias("g"))
    for i in range(rounds):
        own = few.where(F.pmod(F.xxhash64("k"), F.lit(rounds)) == i).toPandas()
        own["n"] = own["v"].map(len)
        held = {at: (g["k"].to_numpy(np.int64), np.stack(g["v"].to_list())) for at, g in own.groupby(["g", "n"])}
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for block in _blocks(batches):
                block["n"] = block["v"].map(len)
                for at, part in block.groupby(["g", "n"]):
                    if at not in shared.value:
                        continue
                    keys, (ids, q), x = part["k"].to_numpy(np.int64), shared.value[at], np.stack(part["v"].to_list())
                    norms = np.sqrt((x * x).sum(axis=1))[:, None], np.sqrt((q * q).sum(axis=1))[None, :]
                    with np.errstate(all="ignore"):
                        s = np.nan_to_num(_rounded(x @ q.T / norms[1] / norms[0]), nan=0.0, posinf=0.0, neginf=0.0)
                    s[keys[:, None] == ids[None, :]] = 0.0
                    least = np.partition(s, len(s) - most, axis=0)[len(s) - most] if len(s) > most else np.zeros(s.shape[1])
                    d, c = np.nonzero((s >= least) & (s > 0))
                    yield pd.DataFrame({"query_id": ids[c], "k": keys[d], "score": s[d, c]})

        found = rows.mapInPandas(run, "query_id long, k long, score double")
        out = found if out is None else out.unionByName(found)
    return R.ranked(out.withColumnRenamed("k", key), "query_id", key, most)
