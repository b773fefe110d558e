"""Lexical, dense and fused retrieval for a table of questions.

Questions are a table, so one and ten thousand take the same plan. The corpus' postings are made once; questions are the
small side of its joins, broadcast if their measured size allows. Top-k is a rank window, which Spark cuts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.runtime import broadcast_if_small, durable

K1, B = 1.5, 0.75
RRF = 60
DIMENSIONS = 512


def rounded(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): how often a term stands in a row, and the row's length in tokens."""
    return _posted(corpus.select(key, F.expr(T.tokens(text)).alias("t")), key)


def _posted(tokenised: DataFrame, key: str) -> DataFrame:
    t = tokenised.select(key, F.explode("t").alias("term"), F.size("t").alias("dl"))
    return t.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def terms(questions: DataFrame, question_key: str, text: str) -> DataFrame:
    """(question_key, term, qn): tokens of each question; one that is asked twice counts twice."""
    t = questions.select(question_key, F.explode(F.expr(T.tokens(text))).alias("term"))
    return t.groupBy(question_key, "term").agg(F.count("*").alias("qn"))


def bm25(corpus: DataFrame, key: str, text: str, questions: DataFrame, question_key: str, question: str) -> DataFrame:
    """(question_key, key, score) of the rows that share a term with a question, by counts over the whole corpus."""
    tokenised = corpus.select(key, F.expr(T.tokens(text)).alias("t"))
    asked = terms(questions, question_key, question)
    wanted = broadcast_if_small(asked.select("term").distinct(), "term")
    # terms that nobody asked for are dropped before they're counted; what is left is used twice
    each = tokenised.select(key, F.explode("t").alias("term"), F.size("t").alias("dl")).join(wanted, "term", "left_semi")
    held = durable(each.groupBy(key, "term", "dl").agg(F.count("*").alias("tf")))
    size = tokenised.select(F.size("t").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    weights = asked.join(df, "term").crossJoin(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = broadcast_if_small(weights.select(question_key, "term", "avgdl", (F.col("qn") * idf).alias("w")), "term")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = held.join(weights, "term").groupBy(question_key, key).agg(F.sum(F.col("w") * tf).alias("score"))
    return scored.withColumn("score", rounded(F.col("score")))


def ranked(scored: DataFrame, question_key: str, key: str, most: int | None = None) -> DataFrame:
    """Positive scores with their rank from 1; equal ones by key."""
    w = Window.partitionBy(question_key).orderBy(F.desc("score"), key)
    out = scored.where("score > 0").withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most) if most else out


def embedded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, w): the hashed bag of words and pairs of each row, sparse and of length one.

    A term's place and sign come from its SHA-1, so no vocabulary is needed.
    """
    t = df.select(key, F.expr(T.tokens(text)).alias("t"))
    pairs = "case when size(t) > 1 then zip_with(slice(t, 1, size(t) - 1), slice(t, 2, size(t) - 1), (a, b) -> concat(a, '_', b)) else array() end"
    counted = t.select(key, F.explode(F.expr(f"concat(t, {pairs})")).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c"))
    digest = F.sha1("term")
    place = (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % DIMENSIONS).cast("int")
    sign = F.when(F.conv(F.substring(digest, 7, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    sums = counted.groupBy(key, place.alias("idx")).agg(F.sum(sign * (1 + F.log("c"))).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return sums.select(key, "idx", F.when(norm > 0, F.col("v") / norm).otherwise(F.col("v")).alias("w"))


def cosines(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(left_key, right_key, score) of sparse vectors that share a place; left is the small side."""
    asked = broadcast_if_small(left.select(left_key, "idx", F.col("w").alias("lw")))
    return right.join(asked, "idx").groupBy(left_key, right_key).agg(rounded(F.sum(F.col("w") * F.col("lw"))).alias("score"))


def fused(dense: DataFrame, lexical: DataFrame, question_key: str, key: str, dense_weight: float) -> DataFrame:
    """Reciprocal rank fusion of two rankings."""
    d = dense.select(question_key, key, (dense_weight / (RRF + F.col("rank"))).alias("d"))
    x = lexical.select(question_key, key, ((1 - dense_weight) / (RRF + F.col("rank"))).alias("x"))
    both = d.join(x, [question_key, key], "full_outer")
    return both.select(question_key, key, (F.coalesce("d", F.lit(0.0)) + F.coalesce("x", F.lit(0.0))).alias("score"))


def dense_cosine(a: str, b: str) -> str:
    """SQL: the cosine of two arrays; 0 if their lengths differ or one has no length."""
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, z) -> s + z)"
    norm = lambda v: f"aggregate({v}, 0D, (s, x) -> s + double(x) * double(x))"
    return f"case when size({a}) != size({b}) or {norm(a)} = 0 or {norm(b)} = 0 then 0D else {dot} / sqrt({norm(a)}) / sqrt({norm(b)}) end"
