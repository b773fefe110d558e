"""Queries that run as streams over all that is available, and of event streams as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.folds import token_bucket
from groundwork.queries.state import SQL as STATE_SQL
from groundwork.queries.text import latest
from groundwork.sources.files import event_frames, event_text
from groundwork.sources.tables import micros, records, table
from groundwork.streaming.order import replay, violations
from groundwork.streaming.stateful import stateful
from groundwork.streaming.windows import drained, file_stream, hourly, sliding, visits


def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    out = drained(hourly(file_stream(spark, folder, "events")))
    return out.select(F.col("hour").cast("string").alias("hour"), "event_type", "n", F.expr("floor(total * 1000 + 0.5) / 1000").alias("total"))


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return drained(sliding(file_stream(spark, folder, "events"))).select(F.col("start").cast("string").alias("start"), "n", "most")


def stream_visits(spark: SparkSession, folder: str) -> DataFrame:
    return drained(visits(file_stream(spark, folder, "events"))).select("user_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "n")


def stream_bucket(spark: SparkSession, folder: str) -> DataFrame:
    e = file_stream(spark, folder, "events").select("event_id", "user_id", micros(F.col("ts")).alias("us"))
    out = stateful(e, "user_id", ["us", "event_id"], ["us"], ["event_id"], token_bucket(3.0, 1 / 7200), "allowed boolean, tokens double, wait_s int")
    return drained(out).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"))


def _trace(spark: SparkSession, folder: str) -> DataFrame:
    """The calls of every diagnosed question as events, in the order of their list."""
    kind = "case when lower(t.name) like '%plan%' then 'plan' when lower(t.name) like '%search%' then 'sources' when lower(t.name) like '%memory%' then 'done' else 'token' end"
    q = records(table(spark, folder, "quick_path"), "record_id", "tools").select("record_id", F.posexplode("tools").alias("i", "t"))
    return q.select("record_id", (F.col("i") + 1).alias("seq"), F.expr(kind).alias("kind"), F.coalesce("t.summary", F.lit("")).alias("summary"))


def stream_order_check(spark: SparkSession, folder: str) -> DataFrame:
    return violations(_trace(spark, folder), "record_id", "seq", "kind")


def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    return replay(_trace(spark, folder), "record_id", "seq", 2).select("record_id", "seq", "nth")


def event_text_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as event-stream text and read again."""
    written = event_text(_trace(spark, folder), "record_id", "seq", "kind", "summary")
    return event_frames(written, "record_id", "text")


QUERIES = {f.__name__: f for f in (stream_hourly, stream_sliding, stream_visits, stream_bucket, stream_order_check, stream_replay, event_text_roundtrip)}

_TRACE = (
    "(select record_id, i as seq, case when lower(name) like '%plan%' then 'plan' when lower(name) like '%search%' then 'sources' when lower(name) like '%memory%' then 'done' else 'token' end as kind, coalesce(summary, '') as summary"
    " from (select record_id, unnest(range(1, len(tools) + 1)) as i, unnest(tools).name as name, unnest(tools).summary as summary from " + latest("quick_path", "record_id") + "))"
)
_MARK = "(select max(ts) - interval 10 minutes from events)"
SQL = {
    "stream_hourly": f"select strftime(h, '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as n, floor(sum(value) * 1000 + 0.5) / 1000 as total from (select *, date_trunc('hour', ts) as h from events) where h + interval 1 hour <= {_MARK} group by 1, 2",
    "stream_sliding": f"select strftime(s, '%Y-%m-%d %H:%M:%S') as start, count(*) as n, max(value) as most from (select *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as s from events) where s + interval 2 hours <= {_MARK} group by 1",
    "stream_visits": f"select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started_at, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as g from (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 15 minutes then 0 else 1 end as new from events)) group by user_id, g having max(ts) + interval 15 minutes <= {_MARK}",
    "stream_bucket": "select user_id, count(*) filter (allowed) as allowed, count(*) filter (not allowed) as blocked from (" + STATE_SQL["token_bucket"] + ") group by 1",
    "stream_order_check": f"with b as (select record_id, min(seq) as s, max(seq) as e, min(seq) filter (kind = 'plan') as plan, min(seq) filter (kind = 'sources') as sources, min(seq) filter (kind = 'token') as token, min(seq) filter (kind = 'done') as done, count(*) filter (kind = 'done') as dones from {_TRACE} group by 1)"
    " select record_id, 'plan_not_first' as rule from b where plan > s union all select record_id, 'token_before_sources' from b where token is not null and (sources is null or token < sources) union all select record_id, 'event_after_done' from b where e > done union all select record_id, 'more_than_one_done' from b where dones > 1",
    "stream_replay": f"select record_id, seq, row_number() over (partition by record_id order by seq) as nth from {_TRACE} where seq > 2",
    "event_text_roundtrip": f"select record_id, seq, kind as event, summary as data from {_TRACE}",
}
