"""Queries of stateful logic over the event log, as batch folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import folds
from groundwork.plans import retrieval as R
from groundwork.queries.text import _tr, latest
from groundwork.sources.tables import micros, records, table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("us"), F.get_json_object("props", "$.k").alias("k"))
    return e.withColumn("failed", F.col("event_type") == "error").withColumn("counts", F.col("event_id") % 5 != 0)


def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    step = folds.token_bucket(capacity=3.0, per_second=1 / 7200)
    out = folds.fold_by_key(_events(spark, folder), "user_id", ["us", "event_id"], ["us"], step, "allowed boolean, tokens double, wait_s int", ["event_id"])
    return out.select("user_id", "event_id", "allowed", F.expr("floor(tokens * 1e6 + 0.5) / 1e6").alias("tokens"))


def ttl_cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    out = folds.fold_by_key(_events(spark, folder), "k", ["us", "event_id"], ["us"], folds.ttl_cache(3600), "hit boolean", ["event_id"])
    return out.groupBy("k").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def circuit_breaker(spark: SparkSession, folder: str) -> DataFrame:
    step = folds.circuit_breaker(threshold=2, cooldown_s=7200)
    return folds.fold_by_key(_events(spark, folder), "user_id", ["us", "event_id"], ["us", "failed", "counts"], step, "state string, rejected boolean", ["event_id"])


def budget_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each run against its budget, with refunds for what failed."""
    c = records(table(spark, folder, "runs"), "run_id", "tool_calls").select("run_id", F.posexplode("tool_calls").alias("i", "c"))
    kind = "case when lower(regexp_replace(c.name, '[^A-Za-z]', '')) like '%websearch%' then 'search' when lower(regexp_replace(c.name, '[^A-Za-z]', '')) like '%fetchpage%' then 'fetch' else 'other' end"
    c = c.select("run_id", "i", F.expr(kind).alias("kind"), F.expr("not c.ok").alias("failed"))
    return folds.fold_by_key(c, "run_id", ["i"], ["kind", "failed"], folds.budget_gate(12, 4, 6), "allowed boolean, used int", ["i"])


def job_leases(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as the life of one job per user: clicks claim, views renew, purchases complete and errors fail."""
    kind = "case event_type when 'click' then 'claim' when 'view' then 'renew' when 'purchase' then 'complete' when 'error' then 'fail' else 'none' end"
    e = _events(spark, folder).withColumn("kind", F.expr(kind))
    return folds.fold_by_key(e, "user_id", ["us", "event_id"], ["us", "kind"], folds.job_lease(3600, 3), "status string, tries int", ["event_id"])


def _memories(spark: SparkSession, folder: str) -> DataFrame:
    """Memories with their trimmed texts; blank ones are none."""
    d = table(spark, folder, "documents").where("source = 'memory' and text is not null")
    return d.select("doc_id", "space_id", F.expr(T.trimmed("text")).alias("text"), micros(F.col("created_at")).alias("us")).where("text != ''")


def memory_upserts(spark: SparkSession, folder: str) -> DataFrame:
    d = _memories(spark, folder)
    return folds.fold_by_key(d, "space_id", ["us", "doc_id"], ["text", "us"], folds.memory_upsert(), "inserted boolean, hits int", ["doc_id"])


def memory_near(spark: SparkSession, folder: str) -> DataFrame:
    """memory_upserts in which a memory whose vector is nearly that of a known one counts as it."""
    d = _memories(spark, folder)
    v = R.embedded(d, "doc_id", "text").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("v"))
    d = d.join(v, "doc_id", "left").select("doc_id", "space_id", "text", "us", F.expr("v.idx").alias("places"), F.expr("v.w").alias("weights"))
    return folds.fold_by_key(d, "space_id", ["us", "doc_id"], ["text", "us", "places", "weights"], folds.memory_upsert(near=0.95), "inserted boolean, hits int", ["doc_id"])


def lru_cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every user's events as reads of a cache of three entries."""
    out = folds.fold_by_key(_events(spark, folder), "user_id", ["us", "event_id"], ["us", "event_type"], folds.lru_cache(7 * 86400, 3), "hit boolean, evicted boolean", ["event_id"])
    return out.select("user_id", "event_id", "hit", "evicted")


def queue_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Every user's events as the life of a queue: views add a job, clicks claim, purchases complete and errors fail the job of
    their number."""
    kind = "case event_type when 'view' then 'add' when 'click' then 'claim' when 'purchase' then 'complete' when 'error' then 'fail' else 'none' end"
    e = _events(spark, folder).withColumn("kind", F.expr(kind)).withColumn("job", F.expr("int(k) % 5"))
    return folds.fold_by_key(e, "user_id", ["us", "event_id"], ["us", "kind", "job"], folds.job_queue(3600, 3), "claimed int, status string", ["event_id"])


def slot_borrowing(spark: SparkSession, folder: str) -> DataFrame:
    """Every deep run's calls as claims of slots by three registered branches."""
    c = records(table(spark, folder, "runs"), "run_id", "depth", "tool_calls").where("depth = 'deep'").select("run_id", F.posexplode("tool_calls").alias("i", "c"))
    c = c.select("run_id", "i", F.expr("int(pmod(coalesce(c.ms, 0), 3))").alias("branch"))
    return folds.fold_by_key(c, "run_id", ["i"], ["branch"], folds.slot_borrowing(total=8, allocations={0: 2, 1: 2, 2: 2}, reserve=1), "granted boolean, borrowed boolean", ["i"])


QUERIES = {f.__name__: f for f in (token_bucket, ttl_cache_hits, circuit_breaker, budget_fold, job_leases, memory_upserts, memory_near, lru_cache_hits, queue_claims, slot_borrowing)}

_ev = lambda key: f"e as (select event_id, user_id, event_type, epoch_us(ts) as us, json_extract_string(props, '$.k') as k, event_type = 'error' as failed, event_id % 5 <> 0 as counts, row_number() over (partition by {key} order by ts, event_id) as rn from events)"
SQL = {
    "token_bucket": f"with recursive {_ev('user_id')}, r as (select user_id, event_id, rn, us, true as allowed, 2.0::double as tokens from e where rn = 1 union all select user_id, event_id, rn, us, t >= 1 as allowed, case when t >= 1 then t - 1 else t end as tokens"
    " from (select e.user_id, e.event_id, e.rn, e.us, least(3.0::double, r.tokens + (e.us - r.us)::double / 1e6::double * (1.0::double / 7200.0::double)) as t from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)) select user_id, event_id, allowed, floor(tokens * 1e6::double + 0.5::double) / 1e6::double as tokens from r",
    "ttl_cache_hits": f"with recursive {_ev('k')}, r as (select k, rn, us + 3600000000 as until, false as hit from e where rn = 1 union all select e.k, e.rn, case when e.us < r.until then r.until else e.us + 3600000000 end, e.us < r.until from r join e on e.k = r.k and e.rn = r.rn + 1) select k, count(*) filter (hit) as hits, count(*) filter (not hit) as misses from r group by 1",
    "circuit_breaker": f"with recursive {_ev('user_id')}, r as (select user_id, event_id, rn, 'closed' as state, false as rejected, case when failed and counts then 1 else 0 end as failures, null::bigint as opened from e where rn = 1 union all"
    " select user_id, event_id, rn, m, m = 'open', case when m = 'open' then f0 when not failed then 0 when counts then f0 + 1 else f0 end, case when m = 'open' then o0 when not failed then null when counts and (m = 'half_open' or f0 + 1 >= 2) then us else o0 end"
    " from (select e.*, r.failures as f0, r.opened as o0, case when r.opened is null then 'closed' when e.us < r.opened + 7200000000 then 'open' else 'half_open' end as m from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)) select user_id, event_id, state, rejected from r",
    "lru_cache_hits": f"with recursive {_ev('user_id')}, r as (select user_id, event_id, rn, [{{'k': event_type, 'u': us + 604800000000}}] as held, false as hit, false as evicted from e where rn = 1 union all"
    " select user_id, event_id, rn, case when len(h) > 3 then h[2:] else h end, hit, len(h) > 3 from (select *, list_append(rest, {'k': event_type, 'u': case when hit then found[1].u else us + 604800000000 end}) as h from (select *, len(found) > 0 as hit from"
    " (select e.*, list_filter(r.held, lambda x: x.k <> e.event_type) as rest, list_filter(r.held, lambda x: x.k = e.event_type and e.us < x.u) as found from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)))) select user_id, event_id, hit, evicted from r",
    "queue_claims": f"with recursive {_ev('user_id')}, q as (select *, k::int % 5 as job, case event_type when 'view' then 'add' when 'click' then 'claim' when 'purchase' then 'complete' when 'error' then 'fail' else 'none' end as kind from e),"
    " r as (select user_id, 0::bigint as event_id, 0::bigint as rn, [{'j': -1, 's': 'none', 't': 0, 'u': 0::bigint}] as jobs, null::int as claimed, null::varchar as status from q where rn = 1 union all"
    " select user_id, event_id, rn, jobs, case when kind = 'claim' then jobs[pos].j end, case when kind = 'claim' then case when pos > 0 then 'running' end else list_filter(jobs, lambda x: x.j = job)[1].s end from (select *, case when kind = 'add' and not known then list_append(held, {'j': job, 's': 'queued', 't': 0, 'u': 0::bigint})"
    " else list_transform(held, lambda x, i: case when i is distinct from pos then x when kind = 'claim' then {'j': x.j, 's': 'running', 't': x.t + (x.s = 'queued')::int, 'u': us + 3600000000} when kind = 'complete' then {'j': x.j, 's': 'completed', 't': x.t, 'u': 0::bigint}"
    " else {'j': x.j, 's': case when x.t < 3 then 'queued' else 'failed' end, 't': x.t, 'u': 0::bigint} end) end as jobs from (select q.*, r.jobs as held, len(list_filter(r.jobs, lambda x: x.j = q.job)) > 0 as known, case when q.kind = 'claim' then list_position(list_transform(r.jobs, lambda x: x.s = 'queued' or (x.s = 'running' and x.u <= q.us)), true)"
    " when q.kind in ('complete', 'fail') then list_position(list_transform(r.jobs, lambda x: x.j = q.job and x.s = 'running'), true) end as pos from r join q on q.user_id = r.user_id and q.rn = r.rn + 1))) select user_id, event_id, claimed, status from r where rn > 0",
    "budget_fold": f"with recursive c as (select run_id, i - 1 as i, case when contains(n, 'websearch') then 'search' when contains(n, 'fetchpage') then 'fetch' else 'other' end as kind, not c.ok as failed from (select run_id, i, c, lower(regexp_replace(c.name, '[^A-Za-z]', '', 'g')) as n from (select run_id, unnest(range(1, len(tool_calls) + 1)) as i, unnest(tool_calls) as c from {latest('runs', 'run_id')}))),"
    " r as (select run_id, -1 as i, 0 as calls, 0 as searches, 0 as fetches, 0 as refunded, false as capped from c where i = 0 union all select run_id, i, calls + (ok and not back)::int, searches + (ok and kind = 'search' and not back)::int, fetches + (ok and kind = 'fetch' and not back)::int, refunded + back::int, not ok"
    " from (select *, ok and kind <> 'other' and coalesce(failed, false) and refunded < 3 as back from (select c.*, r.calls, r.searches, r.fetches, r.refunded, not (r.capped or r.calls >= 12 or (c.kind = 'search' and r.searches >= 4) or (c.kind = 'fetch' and r.fetches >= 6)) as ok from r join c on c.run_id = r.run_id and c.i = r.i + 1)))"
    " select run_id, i, not capped as allowed, calls as used from r where i >= 0",
    "slot_borrowing": f"with recursive c as (select run_id, i - 1 as i, (coalesce(tool_calls[i].ms, 0) % 3 + 3) % 3 as branch from (select run_id, tool_calls, unnest(range(1, len(tool_calls) + 1)) as i from {latest('runs', 'run_id')} where depth = 'deep')),"
    " r as (select run_id, -1 as i, [0, 0, 0] as u, false as granted, false as borrowed from c where i = 0 union all select run_id, i, list_transform([0, 1, 2], lambda b: u[b + 1] + case when b = branch and g then 1 else 0 end), g, g and not within"
    " from (select *, within or 8 - list_sum(u) - list_sum(list_transform([0, 1, 2], lambda b: case when b = branch then 0 else greatest(0, 2 - u[b + 1]) end)) - 1 > 0 as g from (select c.*, r.u, r.u[c.branch + 1] < 2 and list_sum(r.u) < 8 as within from r join c on c.run_id = r.run_id and c.i = r.i + 1)))"
    " select run_id, i, granted, borrowed from r where i >= 0",
    "memory_upserts": "select doc_id, space_id, row_number() over w = 1 as inserted, (row_number() over w - 1)::int as hits from (select *, sha256(lower(" + _tr("text") + ")) as h from documents where source = 'memory' and text is not null and " + _tr("text") + " <> '') window w as (partition by space_id, h order by created_at, doc_id)",
    "job_leases": f"with recursive {_ev('user_id')}, k as (select *, case event_type when 'click' then 'claim' when 'view' then 'renew' when 'purchase' then 'complete' when 'error' then 'fail' else 'none' end as kind from e), r as (select user_id, event_id, rn, case when kind = 'claim' then 'running' else 'queued' end as status, case when kind = 'claim' then 1 else 0 end as tries, case when kind = 'claim' then us + 3600000000 else 0 end as until from k where rn = 1 union all"
    " select k.user_id, k.event_id, k.rn, case when kind = 'claim' and (status = 'queued' or (status = 'running' and us >= until)) then 'running' when status = 'running' and kind = 'complete' then 'done' when status = 'running' and kind = 'fail' then case when tries < 3 then 'queued' else 'failed' end else status end,"
    " case when kind = 'claim' and status = 'queued' then tries + 1 else tries end, case when (kind = 'claim' and (status = 'queued' or (status = 'running' and us >= until))) or (status = 'running' and kind = 'renew') then us + 3600000000 else until end from r join k on k.user_id = r.user_id and k.rn = r.rn + 1) select user_id, event_id, status, tries from r",
}
