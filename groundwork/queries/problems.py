"""The queries of the general problems: sessions (p3) and nested records (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.nested import Child, child_table, link_table, record_column, unnest
from groundwork.operators.sessions import gap_tree, sessions
from groundwork.queries.text import latest
from groundwork.sources.tables import records, table

VISIT_GAP_S = 15 * 60

RECORD_FIELDS = [
    "query", "route", "phases_ms", "tools", "coverage_ok", "coverage_reasons", "rescued", "ttft_ms", "latency_ms",
    "cost_usd", "termination_reason", "sources", "citations", "warnings", "cache",
]
CHILDREN = [
    Child("tools", "tools"),
    Child("attempts", "attempts", within="tools"),
    Child("coverage_reasons", "coverage_reasons", scalar=True),
    Child("warnings", "warnings", scalar=True),
    Child("phases_ms", "phases_ms", kind="names"),
    Child("by_namespace", "cache.by_namespace", kind="names", keep_null=True),
]


def _visits(spark: SparkSession, folder: str) -> DataFrame:
    runs = records(table(spark, folder, "runs"), "run_id", "user_id", "created_at")
    user = F.lower(F.trim(F.col("user_id")))
    return gap_tree(runs.where(F.length(user) > 0), user, F.col("created_at"), F.col("run_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    s = sessions(_visits(spark, folder), VISIT_GAP_S)
    return s.select(F.col("entity").alias("user_id"), F.col("first_id").alias("first_run_id"), F.col("last_id").alias("last_run_id"))


def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    s = sessions(_visits(spark, folder), VISIT_GAP_S)
    return s.select(F.col("entity").alias("user_id"), F.col("first_id").alias("first_run_id"), F.col("last_id").alias("last_run_id"), "started_at", "ended_at", "duration_s", "events")


def p3_gap_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions and their mean length for several thresholds, all cut from one tree."""
    tree = _visits(spark, folder)
    parts = [sessions(tree, 60 * m).agg(F.lit(m).alias("gap_minutes"), F.count("*").alias("sessions"), F.max("events").alias("longest_events")) for m in (1, 5, 15, 60, 240)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _nested(spark: SparkSession, folder: str) -> DataFrame:
    raw = records(table(spark, folder, "quick_path_raw"), "record_id", "payload")
    return unnest(raw, "record_id", "payload", RECORD_FIELDS, CHILDREN)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return link_table(_nested(spark, folder), "record_id", [c.name for c in CHILDREN])


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    return _nested(spark, folder).select(
        "record_id",
        F.lower(F.trim(record_column("route", "string"))).alias("route"),
        record_column("latency_ms", "bigint").alias("latency_ms"),
        record_column("ttft_ms", "bigint").alias("ttft_ms"),
        record_column("cost_usd", "double").alias("cost_usd"),
        record_column("phases_ms.retrieval", "bigint").alias("retrieval_ms"),
        record_column("sources.cited", "bigint").alias("sources_cited"),
        record_column("citations.groundedness", "double").alias("groundedness"),
        *[F.size(c.name).alias(f"n_{c.name}") for c in CHILDREN],
    )


def p4_tools(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"name": "string", "ms": "bigint", "ok": "boolean", "cached": "boolean", "summary": "string"}
    return child_table(_nested(spark, folder), "record_id", "tools", fields)


def p4_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return child_table(
        _nested(spark, folder),
        "record_id",
        "attempts",
        {"ms": "bigint", "ok": "boolean"},
        tool_key="substring_index(child_key, '.', 1)",
        error="coalesce(get_json_object(f['error'], '$.message'), f['error'])",
        code="try_cast(get_json_object(f['error'], '$.code') as int)",
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_sessions, p3_gap_settings, p4_found, p4_records, p4_tools, p4_attempts)}

_VISITS = (
    "r as (select run_id, lower(trim(user_id)) as u, created_at as t from " + latest("runs", "run_id") + " where length(trim(user_id)) > 0 and created_at is not null),"
    " g as (select *, date_diff('microsecond', lag(t) over w, t) as gap from r window w as (partition by u order by t, run_id)),"
    " n as (select *, sum(case when gap <= {0} then 0 else 1 end) over (partition by u order by t, run_id) as k from g)"
)
_SESSION = "select u, arg_min(run_id, (t, run_id)) as a, arg_max(run_id, (t, run_id)) as z, min(t) as s, max(t) as e, count(*) as c from n group by u, k"
_RAW = latest("quick_path_raw", "record_id")
_LAYER = (
    "case json_type(j) when 'VARCHAR' then try_cast(j ->> '$' as json) when 'ARRAY' then case when json_array_length(j) = 1 then j -> 0 end"
    " when 'OBJECT' then coalesce(j -> 'run', j -> 'data', j -> 'attributes', j) end"
)
_RECORD = "w0 as (select record_id, try_cast(trim(regexp_replace(payload, '^\\x{FEFF}', ''), chr(10) || ' ') as json) as j from " + _RAW + ")"
for _i in range(1, 6):
    _RECORD += f", w{_i} as (select record_id, {_LAYER} as j from w{_i - 1} where j is not null)"
_RECORD += ", rec as (select record_id, j from w5 where json_type(j) = 'OBJECT')"
_FIELD = "case when json_type(j -> '{0}') = 'VARCHAR' and regexp_matches(ltrim(j ->> '{0}'), '^[\\[{{]') then try_cast(j ->> '{0}' as json) else j -> '{0}' end"


def _child_sql(field: str) -> str:
    """A list by position, an object of objects by key, and anything else as one entry."""
    keyed = "json_type(x) = 'OBJECT' and len(list_filter(json_keys(x), lambda k: json_type(x -> ('$.\"' || k || '\"')) not in ('OBJECT', 'NULL'))) = 0"
    return (
        f"(select record_id, k, v from (select record_id, unnest(case when json_type(x) = 'ARRAY' then list_transform(range(0, json_array_length(x)::bigint), lambda i: {{'k': i::varchar, 'v': x -> i::int}}) when {keyed} then list_transform(json_keys(x), lambda k: {{'k': k, 'v': x -> ('$.\"' || k || '\"')}})"
        f" else [{{'k': '0', 'v': x}}] end, recursive := true) from (select record_id, {_FIELD.format(field)} as x from rec) where x is not null and json_type(x) <> 'NULL') where v is not null and json_type(v) <> 'NULL')"
    )


_TOOLS = _child_sql("tools")
SQL = {
    "p3_found": f"with {_VISITS.format(900000000)} select u as user_id, a as first_run_id, z as last_run_id from ({_SESSION})",
    "p3_sessions": f"with {_VISITS.format(900000000)} select u as user_id, a as first_run_id, z as last_run_id, s as started_at, e as ended_at, date_diff('microsecond', s, e) / 1e6::double as duration_s, c as events from ({_SESSION})",
    "p3_gap_settings": " union all ".join(f"select {m} as gap_minutes, count(*) as sessions, max(c) as longest_events from (with {_VISITS.format(m * 60_000_000)} {_SESSION})" for m in (1, 5, 15, 60, 240)),
    "p4_found": f"with {_RECORD} select record_id, 'tools' as child, k as child_key from {_TOOLS} union all select record_id, 'coverage_reasons', k from {_child_sql('coverage_reasons')} union all select record_id, 'warnings', k from {_child_sql('warnings')}"
    f" union all select record_id, 'attempts', k || '.' || i from (select record_id, k, unnest(range(0, json_array_length(v -> 'attempts')::bigint)) as i from {_TOOLS} where json_type(v -> 'attempts') = 'ARRAY')"
    " union all select record_id, 'phases_ms', k from (select record_id, j, unnest(json_keys(j -> 'phases_ms')) as k from rec where json_type(j -> 'phases_ms') = 'OBJECT') where json_type(j -> 'phases_ms' -> k) <> 'NULL'"
    " union all select record_id, 'by_namespace', unnest(json_keys(j -> 'cache' -> 'by_namespace')) from rec where json_type(j -> 'cache' -> 'by_namespace') = 'OBJECT'",
    "p4_tools": f"with {_RECORD} select record_id, k as child_key, v ->> 'name' as name, try_cast(v ->> 'ms' as bigint) as ms, try_cast(v ->> 'ok' as boolean) as ok, try_cast(v ->> 'cached' as boolean) as cached, v ->> 'summary' as summary from {_TOOLS}",
    "p4_attempts": f"with {_RECORD} select record_id, k || '.' || i as child_key, try_cast(e ->> 'ms' as bigint) as ms, try_cast(e ->> 'ok' as boolean) as ok, k as tool_key, case when json_type(e -> 'error') = 'OBJECT' then coalesce(e -> 'error' ->> 'message', e ->> 'error') else e ->> 'error' end as error,"
    f" case when json_type(e -> 'error') = 'OBJECT' then try_cast(e -> 'error' ->> 'code' as int) end as code from (select record_id, k, i, v -> 'attempts' -> i::int as e from (select record_id, k, v, unnest(range(0, json_array_length(v -> 'attempts')::bigint)) as i from {_TOOLS} where json_type(v -> 'attempts') = 'ARRAY'))",
    "p4_records": f"with {_RECORD}, c as (select record_id, child, count(*)::int as n from ("
    + " union all ".join(f"select record_id, '{c}' as child from {_child_sql(c)}" for c in ("tools", "coverage_reasons", "warnings"))
    + f" union all select record_id, 'attempts' from (select record_id, unnest(range(0, json_array_length(v -> 'attempts')::bigint)) from {_TOOLS} where json_type(v -> 'attempts') = 'ARRAY')"
    " union all select record_id, 'phases_ms' from (select record_id, j, unnest(json_keys(j -> 'phases_ms')) as k from rec where json_type(j -> 'phases_ms') = 'OBJECT') where json_type(j -> 'phases_ms' -> k) <> 'NULL'"
    " union all select record_id, 'by_namespace' from (select record_id, unnest(json_keys(j -> 'cache' -> 'by_namespace')) from rec where json_type(j -> 'cache' -> 'by_namespace') = 'OBJECT')) group by 1, 2)"
    " select record_id, lower(trim(j ->> 'route')) as route, try_cast(j ->> 'latency_ms' as bigint) as latency_ms, try_cast(j ->> 'ttft_ms' as bigint) as ttft_ms, try_cast(j ->> 'cost_usd' as double) as cost_usd, try_cast(j -> 'phases_ms' ->> 'retrieval' as bigint) as retrieval_ms, try_cast(j -> 'sources' ->> 'cited' as bigint) as sources_cited, try_cast(j -> 'citations' ->> 'groundedness' as double) as groundedness, "
    + ", ".join(f"coalesce((select n from c where c.record_id = rec.record_id and child = '{c.name}'), 0) as n_{c.name}" for c in CHILDREN)
    + " from rec",
}
