"""Queries of chunking, indexing and retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.plans import blocks
from groundwork.plans import chunks as C
from groundwork.plans import retrieval as R
from groundwork.queries.text import _tok
from groundwork.runtime import broadcast_if_small, spread
from groundwork.sources.tables import table

TOP = 6


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").where("text is not null").select("doc_id", "text"), "doc_id")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select("item_id", "question")


def chunk_pages(spark: SparkSession, folder: str) -> DataFrame:
    c = C.chunked(_corpus(spark, folder), "doc_id", "text")
    return c.select("doc_id", "chunk_index", "page", "page_label", "char_start", "char_end", "line", F.md5("text").alias("digest"))


def corpus_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return R.postings(_corpus(spark, folder), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.lexical_best(_corpus(spark, folder), "doc_id", "text", _questions(spark, folder), "item_id", "question", TOP)


def local_embedding(spark: SparkSession, folder: str) -> DataFrame:
    e = R.embedded(_questions(spark, folder), "item_id", "question")
    return e.select("item_id", "idx", R.rounded(F.col("w")).alias("w"))


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    both = blocks.hybrid(_corpus(spark, folder), "doc_id", "text", _questions(spark, folder), "item_id", "question", TOP)
    return R.ranked(both.withColumn("score", R.rounded(F.col("score") * 1000)), "item_id", "doc_id", TOP)


def memory_search(spark: SparkSession, folder: str) -> DataFrame:
    """Memories for every question: cosine and the overlap of words, with a floor."""
    m = table(spark, folder, "documents").where("source = 'memory' and text is not null").select("doc_id", "text")
    return blocks.remembered(m, "doc_id", "text", _questions(spark, folder), "item_id", "question", 5)


def namespace_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest vectors by cosine within each namespace (label), for every vector whose id is divisible by 20."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return blocks.nearest(v, "vec_id", "embedding", "label", v.where("vec_id % 20 = 0"), 10)


def namespace_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Namespaces by their dimensions; more than one says that vectors can't be compared."""
    v = table(spark, folder, "embeddings").select("label", F.concat_ws(":", F.lit("local"), F.lit("hash"), F.size("embedding"), F.lit("v1")).alias("ns"))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("ns").alias("namespaces"))


def space_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each space that has answers: a semi join, and an unknown space is empty, not everything."""
    d = table(spark, folder, "documents").where("space_id is not null")
    some = d.where("source = 'answer'").select("space_id").distinct()
    return d.join(some, "space_id", "left_semi").groupBy("space_id").agg(F.count("*").alias("documents"), F.count("text").alias("with_text"))


def leak_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 12 plain tokens of an anchor that a document holds, by a join on the window's hash, never by nested search."""
    from groundwork.functions.text import plain_tokens

    def windows(df: DataFrame, key: str, text: str) -> DataFrame:
        w = df.select(key, F.expr(plain_tokens(text)).alias("t")).where("size(t) >= 12")
        return w.select(key, F.explode(F.expr("array_distinct(transform(sequence(0, size(t) - 12), i -> xxhash64(array_join(slice(t, i + 1, 12), ' '))))")).alias("w"))

    items = windows(table(spark, folder, "eval_items"), "item_id", "anchor")
    docs = windows(_corpus(spark, folder), "doc_id", "text")
    return docs.join(broadcast_if_small(items), "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("windows"))


def publisher_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The best placed source of each site, at most three per request."""
    from groundwork.functions.urls import last_two_labels
    from groundwork.sources.tables import records

    g = records(table(spark, folder, "grounding_rows"), "rec_id", "request_id", "url", "source_position").where("url is not null and request_id is not null")
    g = g.withColumn("site", F.expr(last_two_labels("url")))
    best = g.withColumn("k", F.row_number().over(Window.partitionBy("request_id", "site").orderBy("source_position", "rec_id"))).where("k = 1")
    chosen = best.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("source_position", "rec_id"))).where("place <= 3")
    return chosen.select("request_id", "site", "rec_id", "place")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_pages, corpus_statistics, bm25_topk, local_embedding, hybrid_search, memory_search, namespace_rank, namespace_consistency, space_scope, leak_windows,
        publisher_choice,
    )
}

CORPUS = "(select doc_id as k, text as x from documents where text is not null)"
ASKED = "(select item_id as k, question as x from eval_items)"
_r = lambda x: f"floor(({x}) * 1e6::double + 0.5::double) / 1e6::double"


def _emb(source: str) -> str:
    return (
        f"(select k, idx, case when sum(v * v) over (partition by k) > 0 then v / sqrt(sum(v * v) over (partition by k)) else v end as w from (select k, ('0x' || sha1(term)[1:6])::int % 512 as idx,"
        f" sum((case when ('0x' || sha1(term)[7:8])::int % 2 = 1 then 1.0::double else -1.0::double end) * (1 + ln(c))) as v from (select k, term, count(*)::double as c from (select k, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) as term"
        f" from (select k, {_tok('x')} as t from {source})) group by 1, 2) group by 1, 2))"
    )


_bm = (
    f"p as (select k, term, dl, count(*)::double as tf from (select k, len(t)::double as dl, unnest(t) as term from (select k, {_tok('x')} as t from {CORPUS})) group by 1, 2, 3),"
    f" st as (select count(*)::double as n, avg(len({_tok('x')})) as avgdl from {CORPUS}), dfs as (select term, count(*)::double as df from p group by 1),"
    f" qs as (select k as item_id, term, count(*)::double as qn from (select k, unnest({_tok('x')}) as term from {ASKED}) group by 1, 2),"
    f" bm as (select item_id, k as doc_id, {_r('sum(qn * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl)))')} as score from qs join dfs using (term) join p using (term), st group by 1, 2)"
)


def _rk(source: str, q: str, k: str, most: int = 0) -> str:
    return f"(select * from (select *, row_number() over (partition by {q} order by score desc, {k}) as rank from {source} where score > 0)" + (f" where rank <= {most})" if most else ")")


_cos = f"cs as (select q.k as item_id, d.k as doc_id, {_r('sum(q.w * d.w)')} as score from {_emb(ASKED)} q join {_emb('{0}')} d using (idx) group by 1, 2)"
MEM = "(select doc_id as k, text as x from documents where text is not null and source = 'memory')"
_pt = lambda x: f"list_filter(string_split(regexp_replace(lower(replace({x}, '’', '''')), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda w: w <> '')"
_win = lambda k, x, t: f"(select distinct {k}, array_to_string(t[i:i + 11], ' ') as w from (select {k}, t, unnest(range(1, len(t) - 10)) as i from (select {k}, {_pt(x)} as t from {t} where {x} is not null)))"
_dot = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: {a}[i]::double * {b}[i]::double))"

SQL = {
    "corpus_statistics": f"select term, count(*) as df, sum(tf)::bigint as cf from (select k, term, count(*) as tf from (select k, unnest({_tok('x')}) as term from {CORPUS}) group by 1, 2) group by 1",
    "bm25_topk": f"with {_bm} select * from {_rk('bm', 'item_id', 'doc_id', TOP)}",
    "local_embedding": f"select k as item_id, idx, {_r('w')} as w from {_emb(ASKED)}",
    "hybrid_search": f"with {_bm}, {_cos.format(CORPUS)}, f as (select coalesce(a.item_id, b.item_id) as item_id, coalesce(a.doc_id, b.doc_id) as doc_id, {_r('(coalesce(0.4::double / (60 + a.rank), 0) + coalesce(0.6::double / (60 + b.rank), 0)) * 1000')} as score from {_rk('cs', 'item_id', 'doc_id')} a full join {_rk('bm', 'item_id', 'doc_id')} b on a.item_id = b.item_id and a.doc_id = b.doc_id)"
    f" select * from {_rk('f', 'item_id', 'doc_id', TOP)}",
    "memory_search": f"with {_cos.format(MEM)}, qt as (select distinct k as item_id, unnest({_tok('x')}) as term from {ASKED}), mt as (select distinct k as doc_id, unnest({_tok('x')}) as term from {MEM}), sh as (select item_id, doc_id, count(*) as shared from qt join mt using (term) group by 1, 2),"
    f" f as (select item_id, doc_id, {_r('0.4::double * score + 0.6::double * coalesce(shared, 0) / least(qs, ms)')} as score from cs left join sh using (item_id, doc_id) join (select item_id, count(*) as qs from qt group by 1) using (item_id) join (select doc_id, count(*) as ms from mt group by 1) using (doc_id))"
    f" select * from {_rk('(select * from f where score >= 0.06)', 'item_id', 'doc_id', 5)}",
    "namespace_rank": f"with s as (select a.vec_id as query_id, b.vec_id, {_r(_dot('a.embedding', 'b.embedding') + ' / sqrt(' + _dot('a.embedding', 'a.embedding') + ') / sqrt(' + _dot('b.embedding', 'b.embedding') + ')')} as score from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select * from {_rk('s', 'query_id', 'vec_id', 10)}",
    "namespace_consistency": "select label, count(*) as n, count(distinct len(embedding)) as namespaces from embeddings group by 1",
    "space_scope": "select space_id, count(*) as documents, count(text) as with_text from documents where space_id in (select space_id from documents where source = 'answer') group by 1",
    "leak_windows": f"select item_id, doc_id, count(*) as windows from {_win('item_id', 'anchor', 'eval_items')} a join {_win('doc_id', 'text', 'documents')} b using (w) group by 1, 2",
    "publisher_choice": "select request_id, site, rec_id, place from (select *, row_number() over (partition by request_id order by source_position, rec_id) as place from (select *, row_number() over (partition by request_id, site order by source_position, rec_id) as k from (select rec_id, request_id, source_position,"
    " array_to_string(string_split(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '.')[-2:], '.') as site from (select *, row_number() over (partition by rec_id order by ingested_at desc) as rn_ from grounding_rows) where rn_ = 1 and url is not null and request_id is not null)) where k = 1) where place <= 3",
}
