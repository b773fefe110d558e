"""Queries of run statistics: percentiles, intervals, rates, streaks, windows and gates over the run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.operators import stats
from groundwork.queries.text import latest
from groundwork.sources.tables import records, table

#: Declared bounds of the example gates.
MOST_SAME_CALLS, MOST_TOKENS, MOST_SECONDS = 4, 180_000, 240


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a request log."""
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.floor(F.col("value") * 10).alias("latency_ms"),
        F.when(F.col("event_type").isin("purchase", "signup"), "deep").otherwise("quick").alias("mode"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return records(table(spark, folder, "runs"), "run_id", "user_id", "depth", "tokens", "wall_clock_sec", "terminated", "tool_calls", "created_at")


def run_stats(spark: SparkSession, folder: str) -> DataFrame:
    r = _runs(spark, folder)
    failed = F.expr("size(filter(tool_calls, c -> not c.ok))")
    return r.groupBy("depth").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("terminated") == "done").alias("done"),
        F.count_if(F.col("terminated") == "cap").alias("cap"),
        F.count_if(F.col("terminated") == "error").alias("error"),
        F.sum("tokens").alias("tokens"),
        F.max("wall_clock_sec").alias("slowest"),
        F.sum(F.greatest(F.lit(0), F.coalesce(F.size("tool_calls"), F.lit(0)))).alias("calls"),
        F.sum(F.greatest(F.lit(0), F.coalesce(failed, F.lit(0)))).alias("failed_calls"),
    )


def run_rollup(spark: SparkSession, folder: str) -> DataFrame:
    r = _runs(spark, folder)
    return r.rollup("depth", "terminated").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.grouping_id().alias("level"))


def run_cube(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).cube("mode", "event_type").agg(F.count("*").alias("n"), F.max("latency_ms").alias("slowest"), F.grouping_id().alias("level"))


def pct_floor_index(spark: SparkSession, folder: str) -> DataFrame:
    return stats.percentile_floor(_log(spark, folder), ["event_type"], "latency_ms", 50, 95)


def pct_nearest_rank(spark: SparkSession, folder: str) -> DataFrame:
    return stats.percentile_nearest(_log(spark, folder), ["mode"], "latency_ms", 50, 95)


def t_interval(spark: SparkSession, folder: str) -> DataFrame:
    got = _runs(spark, folder).groupBy("depth", "terminated").agg(*stats.t_interval("wall_clock_sec"))
    return got.select("depth", "terminated", "n", *[stats.rounded(F.col(c), 6).alias(c) for c in ("mean", "low", "high")])


def wilson_interval(spark: SparkSession, folder: str) -> DataFrame:
    got = _runs(spark, folder).groupBy("depth").agg(*stats.wilson(F.col("terminated") == "done"))
    return got.select("depth", "n", *[stats.rounded(F.col(c), 6).alias(c) for c in ("rate", "low", "high")])


def cache_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    q = records(table(spark, folder, "quick_path"), "record_id", "tools").select(F.explode("tools").alias("t"))
    by = q.groupBy(F.lower(F.regexp_replace("t.name", "[^A-Za-z]", "")).alias("tool")).agg(
        F.count_if("t.cached").alias("hits"), F.count_if(~F.col("t.cached")).alias("misses")
    )
    return by.select("tool", "hits", "misses", stats.hit_rate(F.col("hits"), F.col("misses")).alias("hit_rate"))


def rolling_24h(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the last day before the newest, and those of its calendar day."""
    r = _runs(spark, folder).where("created_at is not null").select("created_at", "tokens", "depth")
    newest = r.agg(F.max("created_at").alias("newest"))
    r = r.crossJoin(F.broadcast(newest))  # one row
    last = F.expr("created_at >= newest - interval 24 hours")
    return r.agg(
        F.count_if(last).alias("runs_24h"),
        F.sum(F.when(last, F.col("tokens"))).alias("tokens_24h"),
        F.count_if(last & (F.col("depth") == "deep")).alias("deep_24h"),
        F.count_if(F.expr("to_date(created_at) = to_date(newest)")).alias("runs_today"),
    )


def rate_blocks(spark: SparkSession, folder: str) -> DataFrame:
    by = _log(spark, folder).groupBy("mode").agg(F.count_if(F.col("event_type") != "error").alias("allowed"), F.count_if(F.col("event_type") == "error").alias("blocked"))
    return by.select("mode", "allowed", "blocked", stats.rounded(F.col("blocked") / (F.col("allowed") + F.col("blocked")), 3).alias("block_rate"))


def tool_streak(spark: SparkSession, folder: str) -> DataFrame:
    return stats.longest_streak(_runs(spark, folder), "run_id", "tool_calls", "name")


def event_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of one event type per user, by islands."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _log(spark, folder).withColumn("new", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("int"))
    islands = e.withColumn("island", F.sum("new").over(w)).groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return islands.groupBy("user_id").agg(F.max("n").alias("streak"), F.count("*").alias("islands"))


def timeline_union(spark: SparkSession, folder: str) -> DataFrame:
    """Runs and their diagnoses per user in one order; rows without a time come last."""
    runs = _runs(spark, folder).select("user_id", F.lit("run").alias("kind"), F.col("run_id").alias("ref"), F.col("created_at").alias("happened_at"))
    quick = records(table(spark, folder, "quick_path"), "record_id", "user_id", "ran_at").select("user_id", F.lit("quick").alias("kind"), F.col("record_id").cast("string").alias("ref"), F.col("ran_at").alias("happened_at"))
    both = runs.unionByName(quick).where("user_id is not null")
    w = Window.partitionBy("user_id").orderBy(F.col("happened_at").asc_nulls_last(), "kind", "ref")
    return both.withColumn("seq", F.row_number().over(w))


def daily_quota(spark: SparkSession, folder: str) -> DataFrame:
    """The first five deep requests of a user and day; later ones are refused and use nothing up."""
    deep = _log(spark, folder).where("mode = 'deep'").withColumn("day", F.to_date("ts").cast("string"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    ranked = deep.withColumn("k", F.row_number().over(w))
    return ranked.groupBy("user_id", "day").agg(F.count("*").alias("asked"), F.count_if(F.col("k") <= 5).alias("allowed"))


def memory_eviction(spark: SparkSession, folder: str) -> DataFrame:
    """Of each user's keys the 200 most used, the latest among equally used."""
    m = _log(spark, folder).groupBy("user_id", "k").agg(F.count("*").alias("hits"), F.max("ts").alias("last_seen"))
    w = Window.partitionBy("user_id").orderBy(F.desc("hits"), F.desc("last_seen"), "k")
    return m.withColumn("rank", F.row_number().over(w)).where("rank <= 200")


def thread_window(spark: SparkSession, folder: str) -> DataFrame:
    """The last eight runs of every thread, in order."""
    r = records(table(spark, folder, "runs"), "run_id", "thread_id", "created_at").where("thread_id is not null")
    last = r.withColumn("back", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.col("created_at").desc_nulls_last(), F.desc("run_id")))).where("back <= 8")
    return last.withColumn("turn", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("back")))).select("thread_id", "run_id", "turn")


def terminated_two_ways(spark: SparkSession, folder: str) -> DataFrame:
    """The two readings of how a run ended, which differ for evidence_limited."""
    q = records(table(spark, folder, "quick_path"), "record_id", "termination_reason")
    streamed = F.when(F.col("termination_reason") == "error", "error").when(F.col("termination_reason").isNull() | F.col("termination_reason").isin("completed", "sufficient_evidence", ""), "done").otherwise("cap")
    exported = F.when(F.col("termination_reason") == "error", "error").when(F.col("termination_reason").isin("capped", "max_tokens", "budget_exhausted", "timeout"), "cap").otherwise("done")
    return q.groupBy("termination_reason").agg(F.count("*").alias("n"), F.first(streamed).alias("streamed"), F.first(exported).alias("exported"))


def rule_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that break each bound, by one pass: calls that failed without a reason, unfinished runs, streaks, tokens, seconds."""
    r = _runs(spark, folder)
    streak = stats.longest_streak(r, "run_id", "tool_calls", "name")
    r = r.join(streak, "run_id")
    mute = F.expr("exists(tool_calls, c -> not c.ok and trim(coalesce(c.error, '')) = '')")
    rules = {
        "silent_failure": F.coalesce(mute, F.lit(False)),
        "unfinished": ~F.col("terminated").eqNullSafe(F.lit("done")),
        "streak": F.col("streak") > MOST_SAME_CALLS,
        "tokens": F.coalesce(F.col("tokens") > MOST_TOKENS, F.lit(False)),
        "seconds": F.coalesce(F.col("wall_clock_sec") > MOST_SECONDS, F.lit(False)),
    }
    counts = r.agg(F.count("*").alias("runs"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    each = "stack(5, " + ", ".join(f"'{n}', {n}" for n in rules) + ") as (rule, failing)"
    return counts.select("runs", F.expr(each)).withColumn("passes", F.col("failing") == 0)


def sla_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Measured values beside their targets; without a value a target is missed."""
    log = _log(spark, folder)
    p95 = stats.percentile_nearest(log, [], "latency_ms", 95).select(F.lit("latency_p95").alias("metric"), F.col("p95").cast("double").alias("actual"))
    rate = log.agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("actual")).select(F.lit("error_rate").alias("metric"), stats.rounded(F.col("actual"), 6).alias("actual"))
    targets = spark.createDataFrame([("latency_p95", "<=", 2500.0), ("error_rate", "<=", 0.01), ("recall", ">=", 0.7)], "metric string, comparator string, target double")
    got = targets.join(p95.unionByName(rate), "metric", "left")
    met = F.when(F.col("comparator") == "<=", F.col("actual") <= F.col("target")).otherwise(F.col("actual") >= F.col("target"))
    return got.withColumn("pass", F.coalesce(met, F.lit(False)))


def budget_consumption(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of a run in order with what is used up by then, and whether the budget still allows each."""
    c = _runs(spark, folder).select("run_id", F.posexplode("tool_calls").alias("i", "c")).select("run_id", "i", F.greatest(F.lit(0), F.coalesce("c.ms", F.lit(0))).alias("ms"))
    w = Window.partitionBy("run_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("calls", F.count("*").over(w)).withColumn("used_ms", F.sum("ms").over(w))
    return c.withColumn("allowed", (F.col("calls") <= 8) & (F.col("used_ms") <= 60_000)).drop("ms")


def nearest_day_before(spark: SparkSession, folder: str) -> DataFrame:
    """As-of: for every grounding row the latest run of its user's request that is not after it, by one sort and last()."""
    g = records(table(spark, folder, "grounding_rows"), "rec_id", "request_id", "ran_at").where("request_id is not null and ran_at is not null")
    r = _runs(spark, folder).where("created_at is not null").select(F.col("run_id").alias("request_id"), F.col("created_at").alias("at"), F.lit(None).cast("long").alias("rec_id"), F.col("created_at"))
    both = r.unionByName(g.select("request_id", F.col("ran_at").alias("at"), "rec_id", F.lit(None).cast("timestamp_ntz").alias("created_at")))
    w = Window.partitionBy("request_id").orderBy("at", F.col("rec_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("run_at", F.last("created_at", ignorenulls=True).over(w)).where("rec_id is not null").select("rec_id", "run_at")


QUERIES = {
    f.__name__: f
    for f in (
        run_stats, run_rollup, run_cube, pct_floor_index, pct_nearest_rank, t_interval, wilson_interval, cache_hit_rate, rolling_24h, rate_blocks, tool_streak,
        event_streaks, timeline_union, daily_quota, memory_eviction, thread_window, terminated_two_ways, rule_failures, sla_rows, budget_consumption, nearest_day_before,
    )
}

LOG = "(select event_id, ts, user_id, event_type, floor(value * 10)::bigint as latency_ms, case when event_type in ('purchase', 'signup') then 'deep' else 'quick' end as mode, json_extract_string(props, '$.k')::bigint as k from events)"
RUNS = latest("runs", "run_id")
QUICK = latest("quick_path", "record_id")
_r6 = lambda x: f"floor(({x}) * 1000000.0::double + 0.5::double) / 1000000.0::double"
_t = "case n - 1 " + " ".join(f"when {i} then {q}::double" for i, q in enumerate(stats.T_95, 1)) + " else 1.96::double end"
_streak = (
    "(select run_id, max(n) as streak from (select run_id, g, count(*) as n from (select run_id, i, sum(new) over (partition by run_id order by i) as g from (select run_id, i, case when i > 1 and name is not distinct from"
    f" lag(name) over (partition by run_id order by i) then 0 else 1 end as new from (select run_id, unnest(range(1, len(tool_calls) + 1)) as i, unnest(tool_calls).name as name from {RUNS}))) group by 1, 2) group by 1)"
)


def _nth(p: int, rank: str, key: str) -> str:
    return f"(select {key} as key_, latency_ms as p{p}, n from (select {key}, latency_ms, count(*) over (partition by {key}) as n, row_number() over (partition by {key} order by latency_ms) as r from {LOG} where latency_ms is not null) where r = {rank})"


SQL = {
    "run_stats": f"select depth, count(*) as runs, count(*) filter (terminated = 'done') as done, count(*) filter (terminated = 'cap') as cap, count(*) filter (terminated = 'error') as error, sum(tokens)::bigint as tokens, max(wall_clock_sec) as slowest,"
    f" sum(coalesce(len(tool_calls), 0))::bigint as calls, sum(coalesce(len(list_filter(tool_calls, lambda c: not c.ok)), 0))::bigint as failed_calls from {RUNS} group by 1",
    "run_rollup": f"select depth, terminated, count(*) as n, sum(tokens)::bigint as tokens, grouping(depth, terminated) as level from {RUNS} group by rollup (depth, terminated)",
    "run_cube": f"select mode, event_type, count(*) as n, max(latency_ms) as slowest, grouping(mode, event_type) as level from {LOG} group by cube (mode, event_type)",
    "pct_floor_index": f"select a.key_ as event_type, p50, a.n, p95 from {_nth(50, 'least(n, floor(n * 0.5) + 1)', 'event_type')} a join {_nth(95, 'least(n, (n * 95) // 100 + 1)', 'event_type')} b on a.key_ = b.key_",
    "pct_nearest_rank": f"select a.key_ as mode, p50, a.n, p95 from {_nth(50, '(n * 50 + 99) // 100', 'mode')} a join {_nth(95, '(n * 95 + 99) // 100', 'mode')} b on a.key_ = b.key_",
    "t_interval": f"select depth, terminated, n, {_r6('m')} as mean, {_r6(f'm - ({_t}) * s / sqrt(n)')} as low, {_r6(f'm + ({_t}) * s / sqrt(n)')} as high from (select depth, terminated, count(wall_clock_sec) as n, avg(wall_clock_sec) as m, stddev_samp(wall_clock_sec) as s from {RUNS} group by 1, 2)",
    "wilson_interval": f"select depth, n, {_r6('p')} as rate, {_r6('greatest(0.0, c - w)')} as low, {_r6('least(1.0, c + w)')} as high from (select depth, n, p, (p + 3.8416::double / (2 * n)) / (1 + 3.8416::double / n) as c, 1.96::double / (1 + 3.8416::double / n) * sqrt(p * (1 - p) / n + 3.8416::double / (4.0 * n * n)) as w"
    f" from (select depth, count(terminated) as n, (count(*) filter (terminated = 'done'))::double / count(terminated) as p from {RUNS} group by 1))",
    "cache_hit_rate": f"select tool, hits, misses, case when hits + misses > 0 then floor(hits::double / (hits + misses) * 1000 + 0.5) / 1000 end as hit_rate from (select lower(regexp_replace(t.name, '[^A-Za-z]', '', 'g')) as tool, count(*) filter (t.cached) as hits, count(*) filter (not t.cached) as misses from (select unnest(tools) as t from {QUICK}) group by 1)",
    "rolling_24h": f"select count(*) filter (created_at >= m - interval 24 hours) as runs_24h, (sum(tokens) filter (created_at >= m - interval 24 hours))::bigint as tokens_24h, count(*) filter (created_at >= m - interval 24 hours and depth = 'deep') as deep_24h, count(*) filter (created_at::date = m::date) as runs_today from (select *, max(created_at) over () as m from {RUNS} where created_at is not null)",
    "rate_blocks": f"select mode, a as allowed, b as blocked, floor(b::double / (a + b) * 1000 + 0.5) / 1000 as block_rate from (select mode, count(*) filter (event_type <> 'error') as a, count(*) filter (event_type = 'error') as b from {LOG} group by 1)",
    "tool_streak": f"select r.run_id, coalesce(s.streak, 0) as streak from {RUNS} r left join {_streak} s using (run_id)",
    "event_streaks": f"select user_id, max(n) as streak, count(*) as islands from (select user_id, g, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id) as g from (select *, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as new from {LOG})) group by 1, 2) group by 1",
    "timeline_union": f"select *, row_number() over (partition by user_id order by happened_at nulls last, kind, ref) as seq from (select user_id, 'run' as kind, run_id as ref, created_at as happened_at from {RUNS} union all select user_id, 'quick', record_id::varchar, ran_at from {QUICK}) where user_id is not null",
    "daily_quota": f"select user_id, day, count(*) as asked, least(5, count(*)) as allowed from (select user_id, ts::date::varchar as day from {LOG} where mode = 'deep') group by 1, 2",
    "memory_eviction": f"select * from (select *, row_number() over (partition by user_id order by hits desc, last_seen desc, k) as rank from (select user_id, k, count(*) as hits, max(ts) as last_seen from {LOG} group by 1, 2)) where rank <= 200",
    "thread_window": f"select thread_id, run_id, row_number() over (partition by thread_id order by back desc) as turn from (select thread_id, run_id, row_number() over (partition by thread_id order by created_at desc nulls last, run_id desc) as back from {RUNS} where thread_id is not null) where back <= 8",
    "terminated_two_ways": f"select termination_reason, count(*) as n, case when termination_reason = 'error' then 'error' when termination_reason is null or termination_reason in ('completed', 'sufficient_evidence', '') then 'done' else 'cap' end as streamed, case when termination_reason = 'error' then 'error' when termination_reason in ('capped', 'max_tokens', 'budget_exhausted', 'timeout') then 'cap' else 'done' end as exported from {QUICK} group by 1",
    "rule_failures": f"select runs, rule, failing, failing = 0 as passes from (select count(*) as runs, count(*) filter (len(list_filter(tool_calls, lambda c: not c.ok and trim(coalesce(c.error, '')) = '')) > 0) as silent_failure, count(*) filter (terminated is distinct from 'done') as unfinished, count(*) filter (coalesce(streak, 0) > 4) as streak, count(*) filter (tokens > 180000) as tokens, count(*) filter (wall_clock_sec > 240) as seconds"
    f" from {RUNS} left join {_streak} s using (run_id)) unpivot (failing for rule in (silent_failure, unfinished, streak, tokens, seconds))",
    "sla_rows": f"with m as (select 'latency_p95' as metric, quantile_disc(latency_ms, 0.95)::double as actual from {LOG} union all select 'error_rate', floor((count(*) filter (event_type = 'error'))::double / count(*) * 1000000 + 0.5) / 1000000 from {LOG}), t(metric, comparator, target) as (values ('latency_p95', '<=', 2500.0::double), ('error_rate', '<=', 0.01::double), ('recall', '>=', 0.7::double))"
    " select metric, comparator, target, actual, coalesce(case when comparator = '<=' then actual <= target else actual >= target end, false) as pass from t left join m using (metric)",
    "budget_consumption": f"select run_id, i - 1 as i, calls, used_ms::bigint as used_ms, calls <= 8 and used_ms <= 60000 as allowed from (select run_id, i, count(*) over w as calls, sum(ms) over w as used_ms from (select run_id, unnest(range(1, len(tool_calls) + 1)) as i, greatest(0, coalesce(unnest(tool_calls).ms, 0)) as ms from {RUNS}) window w as (partition by run_id order by i))",
    "nearest_day_before": f"select g.rec_id, max(r.created_at) as run_at from {latest('grounding_rows', 'rec_id')} g left join {RUNS} r on r.run_id = g.request_id and r.created_at <= g.ran_at where g.request_id is not null and g.ran_at is not null group by 1",
}
