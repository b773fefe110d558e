"""The queries over training data and model logs, by problem, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.llm import percentiles as pct
from groundwork.llm.leaks import find_leaks
from groundwork.llm.runs import collapse_events, collapse_runs, word_share
from groundwork.llm.spans import shared_spans
from groundwork.llm.subjects import found_subjects, subject_shares
from groundwork.llm.tokens import encode_corpus
from groundwork.runtime import spread
from groundwork.sources.tables import records, table

#: The tools that names stand for.
TOOLS = ["web_search", "fetch_page", "search_documents", "recall_memory", "save_memory", "plan_research"]


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery: one that is repeated has the same key and content."""
    parts = [
        table(spark, folder, name).where("rec_id is not null").select(F.lit(name).alias("src_table"), "rec_id", F.col(text).alias("passage"))
        for name, text in (("grounding_rows", "snippet"), ("miss_shapes", "sentence"))
    ]
    return spread(parts[0].unionByName(parts[1]), "rec_id")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(_passages(spark, folder), ["src_table", "rec_id"], "passage")


def p1_shared(spark: SparkSession, folder: str) -> DataFrame:
    """For every record how many of its characters are shared elsewhere."""
    runs = p1_found(spark, folder).groupBy("src_table", "rec_id").agg(F.sum("span_len").alias("shared"), F.max("span_len").alias("longest"))
    every = _passages(spark, folder).groupBy("src_table", "rec_id").agg(F.max(F.coalesce(F.length("passage"), F.lit(0))).alias("characters"))
    return every.join(runs, ["src_table", "rec_id"], "left").fillna(0, ["shared", "longest"])


def _tool(name: str) -> str:
    """SQL: the tool that a name stands for by its letters, else the name as written."""
    letters = f"lower(regexp_replace({name}, '[^\\\\p{{L}}]', ''))"
    cases = " ".join(f"when contains({letters}, '{t.replace('_', '')}') then '{t}'" for t in TOOLS)
    return f"case {cases} else {name} end"


def _tool_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = records(table(spark, folder, "runs"), "run_id", "tool_calls")
    calls = "filter(tool_calls, c -> c.step is not null)"
    ordered = f"array_sort(transform({calls}, (c, i) -> named_struct('step', c.step, 'i', i, 'name', c.name, 'ms', c.ms)))"
    runs = runs.select(F.lit("runs").alias("src_table"), F.col("run_id").alias("rec_id"), F.expr(ordered).alias("c"))
    runs = runs.select("src_table", "rec_id", F.expr("filter(c, (x, i) -> i = 0 or x.step != c[i - 1].step)").alias("c"))
    runs = runs.select(
        "src_table", "rec_id", F.expr(f"transform(c, x -> {_tool('x.name')})").alias("names"), F.expr("c.step").alias("at"), F.expr("c.ms").alias("ms")
    )
    quick = records(table(spark, folder, "quick_path"), "record_id", "tools").select(
        F.lit("quick_path").alias("src_table"),
        F.col("record_id").cast("string").alias("rec_id"),
        F.expr(f"transform(tools, x -> {_tool('x.name')})").alias("names"),
        F.expr("transform(tools, (x, i) -> i + 1)").alias("at"),
        F.expr("tools.ms").alias("ms"),
    )
    return collapse_runs(runs.unionByName(quick), ["src_table", "rec_id"], "names", "at", "ms")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tool_runs(spark, folder).where("events > 1").select("src_table", "rec_id", F.col("first_position").alias("first_step"))


def p2_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every call after collapsing: its tool, how many calls it stands for and their total ms."""
    return _tool_runs(spark, folder).select(
        "src_table", "rec_id", F.col("first_position").alias("first_step"), F.col("label").alias("tool"), F.col("events").alias("calls"), F.col("total_duration").alias("total_ms")
    )


def p2_near(spark: SparkSession, folder: str) -> DataFrame:
    """Successive calls of one question's tools that differ little, by tool and the words of what it found, as one each."""
    quick = records(table(spark, folder, "quick_path"), "record_id", "tools")
    # figures differ from call to call; the rest of a summary says what kind of result came
    label = f"concat(coalesce({_tool('x.name')}, '?'), ' ', coalesce(lower(regexp_replace(x.summary, '[0-9]+', '#')), ''))"
    calls = quick.select("record_id", F.expr(f"transform(tools, x -> {label})").alias("labels"), F.expr("transform(tools, (x, i) -> i + 1)").alias("at"), F.expr("tools.ms").alias("ms"))
    runs = collapse_runs(calls, ["record_id"], "labels", "at", "ms", penalty=0.5, distance=word_share)
    return runs.select("record_id", F.col("first_position").alias("first_step"), F.col("label"), F.col("events").alias("calls"), F.col("total_duration").alias("total_ms"))


def p2_event_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Successive events of a user of one type, as one each with their count and duration."""
    runs = collapse_events(table(spark, folder, "events"), F.col("user_id"), F.col("ts"), F.col("event_id"), F.col("event_type"))
    return runs.select(F.col("entity").cast("long").alias("user_id"), F.col("label").alias("event_type"), "started_at", "duration_s", "events")


def _measures(spark: SparkSession, folder: str) -> DataFrame:
    quick = records(table(spark, folder, "quick_path"), "record_id", "route", "ran_at", "latency_ms", "ttft_ms", "cost_usd")
    quick = quick.where("route is not null")
    each = "stack(3, 'latency_ms', double(latency_ms), 'ttft_ms', double(ttft_ms), 'cost_usd', cost_usd) as (metric, v)"
    return quick.select(
        F.lower(F.trim("route")).alias("route"), F.date_format(F.col("ran_at"), "yyyy-MM-dd").alias("run_day"), F.expr(each)
    ).where("v >= 0")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    days = _measures(spark, folder).where("run_day is not null")
    found = pct.percentiles(days, ["route", "run_day", "metric"], "v", [50, 95]).where("n >= 100")
    wide = found.groupBy("route", "run_day", "metric").agg(
        F.max(F.when(F.col("percentile") == 50, F.col("value"))).alias("p50"), F.max(F.when(F.col("percentile") == 95, F.col("value"))).alias("p95")
    )
    return wide.where("p95 > 6 * p50").select("route", "run_day", "metric")


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """By route and metric, for each day and for all days put together (run_day ``all``)."""
    each = _measures(spark, folder).withColumn("run_day", F.explode(F.array("run_day", F.lit("all"))))
    return pct.percentiles(each, ["route", "run_day", "metric"], "v", [50, 90, 95, 99]).where("run_day is not null")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary: below GROUNDWORK_TOKENIZERS, else where the tokenizer package keeps it."""
    folder = os.environ.get("GROUNDWORK_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_documents(spark, folder), "doc_id", "text", vocabulary("byte_bpe_50k.tiktoken"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_documents(spark, folder), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", ["question", "anchor"])


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document the sentences on each subject and their share."""
    names = [r.subject for r in table(spark, folder, "subjects").where("subject is not null").select("subject").distinct().collect()]
    return subject_shares(_documents(spark, folder), "doc_id", "text", sorted(names), table(spark, folder, "subject_labels"), "doc_id", "subject")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_subjects(p8_shares(spark, folder)).select("doc_id", "subject")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the corpus each subject makes: documents on it, and its share of all sentences on any."""
    by = p8_shares(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))
    total = F.sum("sentences").over(Window.partitionBy(F.lit(0)))
    return by.withColumn("share", F.col("sentences") / total)


QUERIES = {f.__name__: f for f in (p1_found, p1_shared, p2_found, p2_calls, p2_near, p2_event_runs, p5_found, p5_percentiles, p6_ids, p7_found, p8_found, p8_shares, p8_mixture)}


def _latest(name: str, key: str) -> str:
    return f"(select * from (select *, row_number() over (partition by {key} order by ingested_at desc) as rn_ from {name} where {key} is not null) where rn_ = 1)"


def _sql_tool(name: str) -> str:
    letters = f"lower(regexp_replace({name}, '[^\\pL]', '', 'g'))"
    return "case " + " ".join(f"when contains({letters}, '{t.replace('_', '')}') then '{t}'" for t in TOOLS) + f" else {name} end"


_CALLS = (
    f"(select 'runs' as src_table, run_id as rec_id, step as place, name, ms from (select *, row_number() over (partition by run_id, step order by i) as k from (select run_id, i, c.step as step, {_sql_tool('c.name')} as name, c.ms as ms from (select run_id, unnest(range(1, len(tool_calls) + 1)) as i, unnest(tool_calls) as c from {_latest('runs', 'run_id')}))) where k = 1"
    f" union all select 'quick_path', record_id::varchar, i, {_sql_tool('c.name')}, c.ms from (select record_id, unnest(range(1, len(tools) + 1)) as i, unnest(tools) as c from {_latest('quick_path', 'record_id')}))"
)
_COLLAPSED = (
    "(select src_table, rec_id, min(place)::int as first_step, any_value(name) as tool, count(*)::int as calls, coalesce(sum(ms) filter (ms >= 0), 0)::bigint as total_ms from (select *, sum(new) over (partition by src_table, rec_id order by place) as g"
    f" from (select *, case when name = lag(name) over (partition by src_table, rec_id order by place) then 0 else 1 end as new from {_CALLS})) group by src_table, rec_id, g)"
)
_VALUES = (
    f"q as (select lower(trim(route)) as route, strftime(ran_at, '%Y-%m-%d') as run_day, latency_ms::double as a, ttft_ms::double as b, cost_usd as c from {_latest('quick_path', 'record_id')} where route is not null),"
    " v as (select * from (select route, run_day, 'latency_ms' as metric, a as v from q union all select route, run_day, 'ttft_ms', b from q union all select route, run_day, 'cost_usd', c from q) where v is not null and not isnan(v) and not isinf(v) and v >= 0)"
)
_TEXTS = f"(select 'grounding_rows' as src_table, rec_id, snippet as t from {_latest('grounding_rows', 'rec_id')} union all select 'miss_shapes', rec_id, sentence from {_latest('miss_shapes', 'rec_id')})"
_SPANS = (
    f"t as (select * from {_TEXTS} where length(t) >= 80), w as (select src_table, rec_id, i, substr(t, i + 1, 80) as x from (select *, unnest(range(0, length(t) - 79)) as i from t)),"
    " s as (select src_table, rec_id, i from w join (select x from w group by 1 having min((src_table, rec_id)) <> max((src_table, rec_id))) using (x)),"
    " g as (select *, sum(case when i <= p + 80 then 0 else 1 end) over (partition by src_table, rec_id order by i) as k from (select *, lag(i) over (partition by src_table, rec_id order by i) as p from s)),"
    " f as (select src_table, rec_id, min(i)::int as span_start, (max(i) + 80 - min(i))::int as span_len from g group by src_table, rec_id, k)"
)
SQL = {
    "p1_found": f"with {_SPANS} select * from f",
    "p1_shared": f"with {_SPANS} select src_table, rec_id, length(coalesce(t, '')) as characters, coalesce(shared, 0)::bigint as shared, coalesce(longest, 0) as longest from {_TEXTS} left join (select src_table, rec_id, sum(span_len) as shared, max(span_len) as longest from f group by 1, 2) using (src_table, rec_id)",
    "p2_found": f"select src_table, rec_id, first_step from {_COLLAPSED} where calls > 1",
    "p2_calls": f"select * from {_COLLAPSED}",
    "p2_event_runs": "select user_id, event_type, min(ts) as started_at, date_diff('microsecond', min(ts), max(ts)) / 1e6::double as duration_s, count(*) as events from (select *, sum(new) over (partition by user_id order by ts, event_id) as g from (select *, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as new from events)) where user_id is not null group by user_id, event_type, g",
    "p5_found": f"with {_VALUES} select route, run_day, metric from v where run_day is not null group by 1, 2, 3 having count(*) >= 100 and quantile_disc(v, 0.95) > 6 * quantile_disc(v, 0.5)",
    "p5_percentiles": f"with {_VALUES}, e as (select route, unnest([run_day, 'all']) as run_day, metric, v from v), g as (select route, run_day, metric, count(*) as n, quantile_disc(v, [0.5, 0.9, 0.95, 0.99]) as q from e where run_day is not null group by 1, 2, 3) select route, run_day, metric, unnest([50.0, 90.0, 95.0, 99.0])::double as percentile, unnest(q) as value, n from g",
}
