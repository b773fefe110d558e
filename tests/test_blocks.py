"""Searches in blocks against brute force, with small blocks, ties, nulls and rounds of questions."""

import random

import pytest
from pyspark.sql import functions as F

from groundwork.plans import blocks
from groundwork.plans import retrieval as R

WORDS = "apple pear plum fig date lime kiwi melon grape peach the of and".split()


def tables(spark, docs=120, questions=9):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    d = [(i, text(rng.randint(1, 12)), "x") for i in range(docs)] + [(500, None, "x"), (501, "", "x"), (502, "zzz qqq", "x"), (503, "apple pear", "x"), (504, "apple pear", "x")]
    q = [(i, text(rng.randint(1, 4))) for i in range(questions)] + [(90, None), (91, ""), (92, "nowhere found")]
    return spark.createDataFrame(d, "doc_id long, text string, score string"), spark.createDataFrame(q, "item_id long, question string")


def rows(df):
    return sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("bytes_", [blocks.BROADCAST_BYTES, 10_000])
def test_lexical_and_hybrid(spark, monkeypatch, bytes_):
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", bytes_)
    docs, asked = tables(spark)
    known = docs.where("text is not null")
    lexical = R.ranked(R.bm25(known, "doc_id", "text", asked, "item_id", "question"), "item_id", "doc_id")
    got = blocks.lexical_best(docs, "doc_id", "text", asked, "item_id", "question", 5)
    assert rows(got) == rows(lexical.where("rank <= 5"))
    dense = R.ranked(R.cosines(R.embedded(asked.where("question is not null"), "item_id", "question"), "item_id", R.embedded(known, "doc_id", "text"), "doc_id"), "item_id", "doc_id")
    fused = lambda df: R.ranked(df.withColumn("score", R.rounded(F.col("score") * 1000)), "item_id", "doc_id", 6)
    assert rows(fused(blocks.hybrid(docs, "doc_id", "text", asked, "item_id", "question", 6))) == rows(fused(R.fused(dense, lexical, "item_id", "doc_id", 0.4)))


def test_remembered(spark):
    docs, asked = tables(spark)
    known = docs.where("text is not null")
    cosines = {(r.item_id, r.doc_id): r.score for r in R.cosines(R.embedded(asked.where("question is not null"), "item_id", "question"), "item_id", R.embedded(known, "doc_id", "text"), "doc_id").collect()}
    words = lambda t: {w for w in t.lower().split() if len(w) > 1}
    want = []
    for q in asked.where("question is not null").collect():
        near = []
        for d in known.collect():
            both = len(words(q.question) & words(d.text)) / max(1, min(len(words(q.question)), len(words(d.text))))
            score = int((0.4 * cosines.get((q.item_id, d.doc_id), 0.0) + 0.6 * both) * 1e6 + 0.5) / 1e6
            near += [(-score, d.doc_id)] if score >= 0.06 else []
        want += [(q.item_id, r, k, round(-s, 6)) for r, (s, k) in enumerate(sorted(near)[:4], 1)]
    assert rows(blocks.remembered(docs, "doc_id", "text", asked, "item_id", "question", 4)) == sorted(want)


def test_empty_sides(spark):
    docs, asked = tables(spark, 3, 2)
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0))):
        assert blocks.hybrid(d, "doc_id", "text", q, "item_id", "question", 6).count() == 0
        assert blocks.lexical_best(d, "doc_id", "text", q, "item_id", "question", 6).count() == 0


@pytest.mark.parametrize("bytes_", [blocks.BROADCAST_BYTES, 300])
def test_nearest(spark, monkeypatch, bytes_):
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", bytes_)
    rng = random.Random(1)
    data = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], i % 3) for i in range(60)] + [(60, None, 1), (61, [1.0, 1.0], 1), (62, [0.0, 0.0, 0.0], 1), (63, [1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame(data, "id long, v array<float>, g int")
    want = []
    for q, x, g in data:
        if q % 5 == 0 and x is not None and g is not None:
            cos = lambda y: sum(a * b for a, b in zip(x, y, strict=True)) / ((sum(a * a for a in x) or 1) ** 0.5 * (sum(b * b for b in y) or 1) ** 0.5)  # noqa: E731, B023
            near = sorted((-round(cos(y), 6), k) for k, y, h in data if k != q and h == g and y is not None and len(y) == len(x) and cos(y) > 0)[:4]
            want += [(q, r, k, -s) for r, (s, k) in enumerate(near, 1)]
    got = [(r.query_id, r["rank"], r.id, round(r.score, 6)) for r in blocks.nearest(df, "id", "v", "g", df.where("id % 5 = 0"), 4).collect()]
    assert sorted(got) == sorted(want)
