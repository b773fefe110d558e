"""Queries of answering: questions retrieved, answered by extraction, and validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.literals import ansi_text as a
from groundwork.plans import answers as A
from groundwork.plans import evidence as E
from groundwork.plans import blocks
from groundwork.queries.retrieval import ASKED, TOP, _bm, _rk
from groundwork.queries.text import _plan_words
from groundwork.runtime import broadcast_if_small, durable, spread
from groundwork.sources.tables import table


def _found(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").where("text is not null").select("doc_id", "text"), "doc_id")
    asked = table(spark, folder, "eval_items").select("item_id", "question")
    top = blocks.lexical_best(docs, "doc_id", "text", asked, "item_id", "question", TOP)
    return top.join(docs, "doc_id").join(broadcast_if_small(asked, "question"), "item_id").select(F.col("item_id").alias("question_id"), "question", F.col("rank").alias("n"), "doc_id", "text")


def extractive_answers(spark: SparkSession, folder: str) -> DataFrame:
    found = durable(_found(spark, folder))  # the sources that are quoted and those that are checked
    checked = E.validated(A.extractive(found), "question_id", "answer", found.select("question_id", "n", "text"), "n", "text")
    return checked.select("question_id", "answer", F.array_join("cited", ",").alias("cited"), "cited_sentences", "supported_sentences", "groundedness")


def retrieved_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The numbered sources of every question, best first."""
    return _found(spark, folder).select("question_id", "n", "doc_id")


def fallback_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Every question's plan without a planner, checked like a planner's."""
    asked = table(spark, folder, "eval_items").select("item_id", "question").withColumn("plan", F.expr(A.fallback_plan("question")))
    return A.accepted_plan(asked, "item_id", "question", "plan").select("item_id", "i", "item", "problem", "usable")


QUERIES = {f.__name__: f for f in (extractive_answers, retrieved_sources, fallback_plans)}

_angles = "[" + ", ".join(a(x) for x in A.ANGLES) + "]"
_fp = lambda x: f"array_to_string(list_sort({_plan_words.replace('query', x)}), ' ')"
SQL = {
    "retrieved_sources": f"with {_bm} select item_id as question_id, rank as n, doc_id from {_rk('bm', 'item_id', 'doc_id', TOP)}",
    "fallback_plans": f"with p as (select k as item_id, i, x || ': ' || {_angles}[i + 1] as item, x from (select k, x, unnest(range(0, 5)) as i from {ASKED})), f as (select *, {_fp('item')} as fp, {_fp('x')} as fq from p),"
    " g as (select *, case when fp = '' then 'without content' when fp = fq then 'restates the question' when row_number() over (partition by item_id, fp order by i) > 1 then 'repeats another' end as problem from f)"
    " select item_id, i, item, problem, count(*) filter (problem is null) over (partition by item_id) between 3 and 5 as usable from g",
}
