"""Answers without a model: a provider interface, and the extractive default.

A provider is a function from a table of (question, sources) to a table of answers. The default takes from each source the
sentence that has most of the question's words, and cites it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.functions.literals import spark_text as q

Provider = Callable[[DataFrame], DataFrame]

# The angles of a plan that is made without a model.
ANGLES = ["background and definitions", "current state and key facts", "evidence and data", "differing views and limitations", "practical implications"]
# Dashes, and what must not be changed by a change of style.
_PROTECTED = re.compile(r"```.*?```|`[^`\n]*`|https?://\S+|\"[^\"\n]*\"|“[^”\n]*”", re.S)
_RANGE = re.compile(r"(?<=\d)\s*[–—]\s*(?=\d)")
_DASH = re.compile(r"[ \t]*[–—]+[ \t]*")


def extractive(found: DataFrame) -> DataFrame:
    """(question_id, answer) from rows of question_id, question, n and text: the best sentence of each source, with its number."""
    sentences = f"filter(transform(split(text, {q('(?<=[.!?])' + chr(92) + 's+')}), s -> trim(s)), s -> length(s) between 20 and 400)"
    each = found.select("question_id", "n", "question", F.posexplode(F.expr(sentences)).alias("i", "s"))
    scored = each.withColumn("score", F.expr(T.coverage("s", "question"))).withColumn("k", F.row_number().over(Window.partitionBy("question_id", "n").orderBy(F.desc("score"), "i"))).where("k = 1 and score > 0")
    cited = F.concat(F.regexp_replace("s", r"\s*\[[\d,\s]+\]", ""), F.lit(" ["), F.col("n").cast("string"), F.lit("]"))
    return scored.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", cited.alias("c")))), lambda x: x["c"]), "\n\n").alias("answer"))


def fallback_plan(question: str) -> str:
    """SQL: array<string> of sub-questions from templates, for when no planner answers."""
    return "array(" + ", ".join(f"concat({question}, ': ', '{a}')" for a in ANGLES) + ")"


def accepted_plan(plan: DataFrame, key: str, question: str, items: str, least: int = 3, most: int = 5) -> DataFrame:
    """(key, i, item, problem) of every sub-question: empty, without content, restating the question, or a repetition; others
    have none, and ``usable`` says whether least to most of the plan are left."""
    each = plan.select(key, question, F.posexplode(items).alias("i", "item")).withColumn("print", F.expr(T.plan_fingerprint("coalesce(item, '')")))
    repeated = F.row_number().over(Window.partitionBy(key, "print").orderBy("i")) > 1
    problem = (
        F.when(F.trim(F.coalesce("item", F.lit(""))) == "", "empty")
        .when(F.col("print") == "", "without content")
        .when(F.col("print") == F.expr(T.plan_fingerprint(question)), "restates the question")
        .when(repeated, "repeats another")
    )
    each = each.withColumn("problem", problem)
    good = F.count_if(F.col("problem").isNull()).over(Window.partitionBy(key))
    return each.select(key, "i", "item", "problem", good.between(least, most).alias("usable"))


def plain_style(text: str) -> str:
    """Without dashes: ranges of numbers read ``to``, others a comma; code, addresses and quotations stay."""
    out, at = [], 0
    for m in [*_PROTECTED.finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        out.append(_DASH.sub(", ", _RANGE.sub(" to ", part)))
        if m:
            out.append(m.group())
            at = m.end()
    return re.sub(r",\s*([,.;:!?])", r"\1", "".join(out))


def loose_json(text: str):  # noqa: ANN201
    """The JSON value in a reply: a fenced block first, else the whole, else the first balanced part; None if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for candidate in ([fenced.group(1)] if fenced else []) + [text]:
        try:
            return json.loads(candidate)
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def kept_memories(extracted: DataFrame, confidence: str, most: int = 5, least: float = 0.5) -> DataFrame:
    """Of each run's extracted memories the surest, if sure enough."""
    w = Window.partitionBy("run_id").orderBy(F.desc(confidence), "content")
    return extracted.where(F.col(confidence) >= least).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")
