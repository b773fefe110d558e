"""Queries that audit runs, sources and sentences, and the reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions import literals as L
from groundwork.functions import text as T
from groundwork.functions.literals import ansi_text as a
from groundwork.functions.literals import spark_text as q
from groundwork.operators import stats
from groundwork.plans import audit as A
from groundwork.plans import evidence as E
from groundwork.plans import blocks
from groundwork.queries.evidence import G, M, _grounding
from groundwork.queries.retrieval import _bm, _corpus, _pt, _questions, _rk
from groundwork.queries.stats import _log, _runs
from groundwork.queries.text import _absent, latest
from groundwork.sources.tables import micros, records, table

#: Declared example values: prices per million, and targets.
PRICES = [("deep", 3.0, 15.0), ("quick", 1.0, 5.0)]
TARGETS = [("latency_p95", "<=", 2500.0), ("error_rate", "<=", 0.01), ("grounding", ">=", 0.95), ("cache_hit_rate", ">=", 0.5), ("recall", ">=", 0.7)]
_letters = lambda x: f"lower(regexp_replace({x}, '[^A-Za-z]', ''))"
_half_up = lambda x, places=6: f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    return records(table(spark, folder, "miss_shapes"), "rec_id", "run_id", "sentence", "best_support", "shape", "variant").where("sentence is not null")


def factual_audit(spark: SparkSession, folder: str) -> DataFrame:
    """By variant: the sentences that state something, those with a citation, and disclosures of gaps, which need none."""
    m = _sentences(spark, folder).where(A.factual("sentence")).withColumn("cited", F.expr("sentence rlike '\\\\[[0-9]'")).withColumn("gap", F.expr(T.absence_claim("sentence")))
    by = m.groupBy("variant").agg(
        F.count("*").alias("factual"), F.count_if("cited").alias("cited"), F.count_if(F.expr("gap and not cited")).alias("disclosures"),
        F.max(F.expr("case when not cited then best_support end")).alias("best_uncited"),
    )
    return by.withColumn("excluding_disclosures", F.col("factual") - F.col("disclosures"))


def misgrounded(spark: SparkSession, folder: str) -> DataFrame:
    """Why sentences aren't supported by the source they cite, here the one numbered by their place: compared with every source of
    their run, words taken once on either side before the join."""
    claims = _sentences(spark, folder).where("run_id is not null").select(
        "rec_id", "run_id", F.expr("rec_id % 7 + 1").alias("ref"), F.expr("coalesce(best_support, 0D)").alias("support"), F.expr(A.plain_words("sentence")).alias("c"),
        F.expr(f"filter(regexp_extract_all(sentence, {q(A.FIGURE)}, 0), f -> length(f) > 1)").alias("figures"),
    )
    sources = _sources(spark, folder).select("run_id", "n", "snippet", F.expr(A.plain_words("coalesce(snippet, '')")).alias("w"))
    score = F.expr("case when size(c) = 0 then 1D else size(array_intersect(c, w)) / size(c) end")
    each = claims.join(sources, "run_id", "left").withColumn("score", score)
    by = each.groupBy("rec_id").agg(
        F.max("score").alias("score"), F.min_by("n", F.struct(-F.col("score"), "n")).alias("n"), F.first("ref").alias("ref"), F.first("support").alias("support"),
        F.first("figures").alias("figures"), F.count_if(F.expr("n = ref")).alias("cited"), F.max(F.expr("case when n = ref then coalesce(snippet, '') end")).alias("text"),
    )
    why = A.misgrounding("coalesce(score, 0D)", "coalesce(n = ref, false)", "cited", "false", "support", "figures", "coalesce(text, '')")
    return by.select("rec_id", F.expr(why).alias("category"), F.expr("case when score >= 0.6 and n != ref then n end").alias("better_source"))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of every run by citation number; of several rows with one number the first."""
    g = records(table(spark, folder, "grounding_rows"), "rec_id", "request_id", "citation", "snippet").where("request_id is not null and citation is not null")
    return g.groupBy(F.col("request_id").alias("run_id"), F.col("citation").alias("n")).agg(F.min_by("snippet", "rec_id").alias("snippet"))


def call_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as results of clicks by the same user on the same of five tools."""
    e = table(spark, folder, "events").select(
        "event_id", "user_id", F.expr("int(get_json_object(props, '$.k')) % 5").alias("tool"), micros(F.col("ts")).alias("us"),
        F.expr("case event_type when 'click' then 'call' when 'purchase' then 'result' else 'other' end").alias("kind"),
    )
    p = A.paired_calls(e, ["user_id", "tool"], ["us", "event_id"], "kind", F.col("us"))
    return p.select("event_id", F.col("call.event_id").alias("call_id"), F.expr("waited div 1000000").alias("seconds"))


def known_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages further down that none of the request's first three sources is."""
    g = _grounding(spark, folder).where("url is not null and request_id is not null").select("rec_id", "request_id", "url", "source_position")
    known = g.where("source_position <= 3").select("request_id", "url").distinct()
    return g.where("source_position > 3").join(known, ["request_id", "url"], "left_anti").select("rec_id", "request_id")


_SOURCE_KEY = "coalesce(url, concat('doc:', source_doc_id))"


def ledger_sources(spark: SparkSession, folder: str) -> DataFrame:
    g = records(table(spark, folder, "grounding_rows"), "rec_id", "request_id", "citation", "source_doc_id", "url", "source_position").where("request_id is not null")
    led = A.ledger(g, "request_id", F.expr(_SOURCE_KEY), F.col("citation"), ["source_position", "rec_id"])
    return led.select("request_id", "source", "n", F.array_join(F.col("branches").cast("array<string>"), ",").alias("branches"), "seen")


def rendered_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The snippets of a request for a prompt, those that were found best first."""
    g = _grounding(spark, folder).where("request_id is not null")
    r = A.rendered(g, "request_id", [-F.coalesce("longest_window", F.lit(0)), F.col("rec_id")], "snippet")
    return r.select("request_id", F.md5("shown").alias("digest"), F.length("shown").alias("characters"), "dropped")


def source_locators(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("page_label is not null").select("doc_id", "page_label", F.expr(A.locator("page_label")).alias("l"))
    key = "concat_ws(':', doc_id, coalesce(string(l.page), ''), coalesce(l.heading, ''), '')"
    return d.select("doc_id", F.col("l.page").alias("page"), F.col("l.heading").alias("heading"), F.expr(key).alias("locator_key"))


def gold_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether one of the five best documents for a question holds six words in a row of the passage that answers it."""
    docs = _corpus(spark, folder)
    top = blocks.lexical_best(docs, "doc_id", "text", _questions(spark, folder), "item_id", "question", 5).select("item_id", "doc_id")
    items = table(spark, folder, "eval_items").select("item_id", F.expr(T.plain_tokens("coalesce(anchor, '')")).alias("t"))
    held = docs.join(top, "doc_id").join(items, "item_id").withColumn("hay", F.expr(f"array_join({T.plain_tokens('text')}, ' ')"))
    hits = held.groupBy("item_id").agg(F.max(F.expr(E.grounded("t", "hay", 6))).alias("hit"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def gold_placement(spark: SparkSession, folder: str) -> DataFrame:
    """Where the passages that answer the questions stand in the corpus, and what is wrong with those that don't."""
    return A.placed(table(spark, folder, "eval_items").select("item_id", "anchor"), "item_id", "anchor", _corpus(spark, folder), "doc_id", "text")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every declared rule by what it checked and how much fails: runs by one pass, the gold set, and the measured thresholds."""
    r = records(table(spark, folder, "runs"), "run_id", "depth", "tokens", "cost_usd", "wall_clock_sec", "terminated", "tool_calls")
    names = f"transform(coalesce(tool_calls, array()), c -> coalesce({_letters('c.name')}, ''))"
    called = lambda tool: f"exists({names}, n -> contains(n, '{tool}'))"
    streak = stats.longest_streak(r, "run_id", "tool_calls", "name")
    rules = {
        "A1": "coalesce(exists(tool_calls, c -> not c.ok and trim(coalesce(c.error, '')) = ''), false)", "A2": "not terminated <=> 'done'", "A3": "streak > 4",
        "R1": f"not ({called('websearch')} or {called('fetchpage')})", "R2": f"depth <=> 'quick' and {called('planresearch')}",
        "B1": "coalesce(tokens > 180000, false)", "B2": "coalesce(wall_clock_sec > 240, false)", "B3": "coalesce(cost_usd > 0.35, false)",
    }
    counts = r.join(streak, "run_id").agg(F.count("*").alias("checked"), *[F.count_if(F.expr(c)).alias(n) for n, c in rules.items()])
    each = counts.select(F.expr(f"stack({len(rules)}, " + ", ".join(f"'{n}', checked, {n}" for n in rules) + ") as (rule, checked, failing)"))
    gold = table(spark, folder, "eval_items").agg(F.count("*").alias("checked")).select(F.lit("E1").alias("rule"), "checked", F.expr("if(checked < 30, 1L, 0L)").alias("failing"))
    measured = bench_metrics(spark, folder).join(spark.createDataFrame([t for t in TARGETS if t[2] <= 1], "metric string, comparator string, target double"), "metric")
    met = measured.agg(F.count("*").alias("checked"), F.count_if(F.expr("not case when comparator = '<=' then actual <= target else actual >= target end")).alias("failing")).select(F.lit("E2").alias("rule"), "checked", "failing")
    return each.unionByName(gold).unionByName(met).withColumn("passes", F.col("failing") == 0)


def run_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by depth against each gate: deep ones plan first and stay within 24 calls, quick ones never plan and stay within 8."""
    r = _runs(spark, folder).where("depth is not null")
    names = F.expr(f"transform(array_sort(transform(filter(tool_calls, c -> c.step is not null), (c, i) -> named_struct('s', c.step, 'i', i, 'n', {_letters('c.name')}))), x -> coalesce(x.n, ''))")
    r = r.select("depth", F.coalesce(names, F.expr("array()")).alias("n"), F.expr("greatest(0, coalesce(size(tool_calls), 0))").alias("calls"))
    plans = "exists(n, x -> contains(x, 'planresearch'))"
    by = r.groupBy("depth").agg(
        F.count("*").alias("runs"),
        F.count_if(F.expr(f"case when depth = 'deep' then size(n) > 0 and contains(n[0], 'planresearch') else not {plans} end")).alias("plan"),
        F.count_if(F.expr("calls <= case when depth = 'deep' then 24 else 8 end")).alias("calls"),
        F.max("calls").alias("most_calls"),
    )
    return by.select("depth", "runs", "most_calls", F.expr("stack(2, 'plan', plan, 'calls', calls) as (gate, passing)")).withColumn("pass", F.col("passing") == F.col("runs"))


def deep_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """By question: the distinct sources of its deep runs on average against those of its quick ones."""
    r = records(table(spark, folder, "runs"), "run_id", "query", "depth").where("query is not null and depth is not null")
    s = records(table(spark, folder, "grounding_rows"), "rec_id", "request_id", "source_doc_id", "url").where("request_id is not null")
    s = s.groupBy(F.col("request_id").alias("run_id")).agg(F.count_distinct(F.expr(_SOURCE_KEY)).alias("sources"))
    by = r.join(s, "run_id").groupBy("query").agg(*[F.avg(F.when(F.col("depth") == d, F.col("sources"))).alias(d) for d in ("deep", "quick")])
    return by.where("deep is not null and quick > 0").select("query", *[F.expr(_half_up(x)).alias(n) for n, x in (("deep", "deep"), ("quick", "quick"), ("ratio", "deep / quick"))])


def distinct_sources(spark: SparkSession, folder: str) -> DataFrame:
    g = records(table(spark, folder, "grounding_rows"), "rec_id", "request_id", "url", "source_doc_id", "locator").where("request_id is not null")
    place = "coalesce(url, concat(source_doc_id, ':', coalesce(string(locator.page), locator.heading, '')))"
    return g.groupBy("request_id").agg(F.count_distinct(F.expr(place)).alias("sources"), F.count("url").alias("web"))


def snapshot_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of memories and notes that only one of the two sources holds the text of."""
    d = table(spark, folder, "documents").where("text is not null").select("source", F.md5("text").alias("digest"))
    return A.snapshot_delta(d.where("source = 'memory'"), d.where("source = 'note'"), "digest")


def ingest_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """The 95th percentile while busy, here in even hours, against that at other times; null if there is none of either."""
    log = _log(spark, folder).withColumn("phase", F.when(F.hour("ts") % 2 == 0, "busy").otherwise("idle"))
    p = stats.percentile_nearest(log, ["phase"], "latency_ms", 95)
    by = p.agg(*[F.max(F.when(F.col("phase") == n, F.col("p95"))).alias(n) for n in ("busy", "idle")])
    return by.withColumn("ratio", F.expr(_half_up("busy / idle")))


def workload(spark: SparkSession, folder: str) -> DataFrame:
    """As many asks as there are questions, half of them repeats that go round the fresh ones."""
    items = table(spark, folder, "eval_items").select("item_id", "question")
    n = items.agg(F.count("*").alias("n")).first()["n"]
    fresh = n - int(n * 0.5 + 0.5)
    asks = spark.range(n).select(F.col("id").alias("i"), F.expr(f"case when id < {fresh} then id else (id - {fresh}) % {max(fresh, 1)} end + 1").alias("item_id"))
    return asks.join(items, "item_id").select("i", "item_id", (F.col("i") >= fresh).alias("repeat"))


def fetch_stops(spark: SparkSession, folder: str) -> DataFrame:
    """Where reading a request's sources in order could stop: usable ones of two sites."""
    g = _grounding(spark, folder).where("request_id is not null").withColumn("usable", F.expr("length(trim(coalesce(snippet, ''))) > 80"))
    g = g.withColumn("site", F.expr(f"coalesce(regexp_extract(url, '^https?://([^/?#:]*)', 1), concat('doc:', source_doc_id))"))
    return A.first_enough(g, "request_id", ["source_position", "rec_id"], "usable", "site")


def sweep_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Sites that none of a request's first five sources stands on: three at most, by place."""
    g = _grounding(spark, folder).where("url is not null and request_id is not null").withColumn("site", F.expr("lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))"))
    read = g.where("source_position <= 5").select("request_id", "site").distinct()
    left = g.where("source_position > 5").join(read, ["request_id", "site"], "left_anti").groupBy("request_id", "site").agg(F.min(F.struct("source_position", "rec_id")).alias("first"))
    k = F.row_number().over(Window.partitionBy("request_id").orderBy("first"))
    return left.withColumn("k", k).where("k <= 3").select("request_id", "site", "k")


def rubric_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Runs on three points: they ended, they used a tool, and no call failed."""
    parts = ["terminated <=> 'done'", "coalesce(size(tool_calls), 0) > 0", "not coalesce(exists(tool_calls, c -> not c.ok), false)"]
    r = _runs(spark, folder).select("run_id", F.expr(" + ".join(f"int({p})" for p in parts)).alias("passed"))
    return r.select("run_id", "passed", F.expr(A.award("passed", "3", 10)).alias("x")).select("run_id", "passed", "x.points", "x.verdict")


def adjudicated(spark: SparkSession, folder: str) -> DataFrame:
    """Uncited sentences by variant: supported after all, unsupported, and artefacts of splitting, with their rates."""
    m = _sentences(spark, folder)
    artefact = F.col("shape").isin("list_introduction", "quotation_fragment")
    by = m.groupBy("variant").agg(
        F.count("*").alias("n"), F.count_if(artefact).alias("artefacts"), F.count_if(~artefact & (F.col("best_support") >= 0.5)).alias("supported"),
        F.count_if(~artefact & (F.coalesce("best_support", F.lit(0.0)) < 0.5)).alias("unsupported"),
    )
    return by.select("*", *[F.expr(_half_up(f"{c} / n")).alias(f"{c}_rate") for c in ("artefacts", "supported", "unsupported")])


def case_summary(spark: SparkSession, folder: str) -> DataFrame:
    """By question: how many runs ended, by an interval, and how their time spreads."""
    r = records(table(spark, folder, "runs"), "run_id", "query", "terminated", "wall_clock_sec").where("query is not null")
    by = r.groupBy("query").agg(*stats.wilson(F.col("terminated") == "done"), F.avg("wall_clock_sec").alias("mean_s"), F.count_if(F.col("terminated") == "cap").alias("capped"), F.count_if(F.col("terminated") == "error").alias("failed"))
    return by.select("query", "n", "capped", "failed", *[F.expr(_half_up(c)).alias(c) for c in ("rate", "low", "high", "mean_s")])


def run_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    r = records(table(spark, folder, "runs"), "run_id", "query", "depth", "terminated")
    return r.select("run_id", F.sha2(F.concat_ws("|", "run_id", F.coalesce("query", F.lit("")), F.coalesce("depth", F.lit("")), F.coalesce("terminated", F.lit(""))), 256).alias("fingerprint"))


def thread_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Of each thread its first question, 80 characters at most, and that question with the year for a search of the recent."""
    r = records(table(spark, folder, "runs"), "run_id", "thread_id", "query", "created_at").where("thread_id is not null and query is not null and created_at is not null")
    by = r.groupBy("thread_id").agg(F.min_by(F.struct("query", "created_at"), F.struct("created_at", "run_id")).alias("x"))
    return by.select("thread_id", F.expr("left(x.query, 80)").alias("title"), F.expr("concat(x.query, ' ', year(x.created_at))").alias("recent"))


def search_then_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Runs in which a page is fetched only after a search, by the first call of either, and those that own up when capped."""
    r = _runs(spark, folder)
    n = f"transform(tool_calls, c -> case when contains({_letters('c.name')}, 'websearch') then 's' when contains({_letters('c.name')}, 'fetchpage') then 'f' else 'o' end)"
    r = r.select("run_id", "terminated", F.expr(f"array_position({n}, 's')").alias("s"), F.expr(f"array_position({n}, 'f')").alias("f"))
    return r.where("f > 0").select("run_id", F.expr("s > 0 and s < f").alias("in_order"), (F.col("terminated") == "cap").alias("capped"))


def markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(F.expr(A.sections("text"))).alias("i", "heading"))
    return d.select("doc_id", "i", F.expr(T.trimmed("heading")).alias("heading"))


def memory_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of a thread as a tagged block for a prompt, each cut at 40 characters."""
    r = records(table(spark, folder, "runs"), "run_id", "thread_id", "query", "created_at").where("thread_id is not null and query is not null")
    turns = F.array_sort(F.collect_list(F.struct("created_at", "run_id", F.expr("left(query, 40)").alias("t"))))
    by = r.groupBy("thread_id").agg(F.array_join(F.transform(turns, lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("t"))
    return by.select("thread_id", F.concat(F.lit("<turns>\n"), "t", F.lit("\n</turns>")).alias("block"))


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """The calls of a run in order of their steps, numbered from 1 without gaps."""
    r = records(table(spark, folder, "runs"), "run_id", "tool_calls")
    steps = "array_sort(transform(filter(tool_calls, c -> c.step is not null), (c, i) -> named_struct('step', c.step, 'i', i, 'name', c.name, 'ok', c.ok)))"
    return r.select("run_id", F.posexplode(F.expr(steps)).alias("k", "c")).select("run_id", (F.col("k") + 1).alias("n"), "c.step", "c.name", "c.ok")


def offered_tools(spark: SparkSession, folder: str) -> DataFrame:
    """By space: the tools offered in each mode; documents only where some are indexed."""
    d = table(spark, folder, "documents").where("space_id is not null").groupBy("space_id").agg(F.count_if(F.col("status") == "indexed").alias("indexed"))
    modes = d.select("space_id", "indexed", F.explode(F.expr("array('auto', 'docs', 'web')")).alias("mode"))
    return modes.select("space_id", "mode", F.expr("mode != 'docs'").alias("web"), F.expr("mode != 'web' and indexed > 0").alias("documents"))


def input_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with a run as the input of a tool: its query's length and its depth."""
    r = records(table(spark, folder, "runs"), "run_id", "query", "depth")
    size = "length(trim(coalesce(query, '')))"
    checks = f"concat_ws('; ', case when {size} < 3 then 'query: too short' when {size} > 40 then 'query: too long' end, case when depth is null or depth not in ('quick', 'deep') then 'depth: unknown' end)"
    return r.select("run_id", F.expr(checks).alias("problems")).where("problems != ''")


def redacted_props(spark: SparkSession, folder: str) -> DataFrame:
    """Events' properties with a secret added, as they may be logged."""
    raw = "concat('{\"apiKey\": \"', md5(string(event_id)), '\", \"inner\": {\"user_token\" : \"x\"}, \"rest\": ', coalesce(props, 'null'), '}')"
    return table(spark, folder, "events").select("event_id", F.expr(A.redacted(raw)).alias("props"))


def public_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as they are shown: no internals, and the first of the branches that found them."""
    led = ledger_sources(spark, folder)
    return led.select("request_id", "n", "source", F.expr("split(branches, ',')[0]").alias("branch"), F.expr("case when source like 'doc:%' then 'doc' else 'web' end").alias("kind"))


def call_costs(spark: SparkSession, folder: str) -> DataFrame:
    """By depth: what runs would cost at declared prices, a sixth of the tokens being output."""
    r = _runs(spark, folder).select("depth", F.col("tokens").alias("tokens_in"), F.expr("tokens div 6").alias("tokens_out"))
    prices = spark.createDataFrame(PRICES, "model string, tokens_in double, tokens_out double")
    return A.priced(r, "depth", ["tokens_in", "tokens_out"], prices).groupBy("depth").agg(F.count("*").alias("runs"), F.sum("cost").alias("c")).select("depth", "runs", F.expr(_half_up("c")).alias("cost"))


def bench_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The report's measures, one row each; grounding leaves out what can't be verified."""
    log = _log(spark, folder)
    g = records(table(spark, folder, "grounding_rows"), "rec_id", "category")
    tools = records(table(spark, folder, "quick_path"), "record_id", "tools").select(F.explode("tools").alias("t"))
    parts = [
        stats.percentile_nearest(log, [], "latency_ms", 95).select(F.lit("latency_p95").alias("metric"), F.col("p95").cast("double").alias("actual")),
        log.agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("x")).select(F.lit("error_rate").alias("metric"), F.expr(_half_up("x")).alias("actual")),
        g.agg((F.count_if(F.col("category") == "provenance verified") / F.count_if(F.col("category") != "web page fetch blocked")).alias("x")).select(F.lit("grounding").alias("metric"), F.expr(_half_up("x")).alias("actual")),
        tools.agg((F.count_if("t.cached") / F.count("t.cached")).alias("x")).select(F.lit("cache_hit_rate").alias("metric"), F.expr(_half_up("x")).alias("actual")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def sla_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every target beside its measure; recall comes from the gold questions."""
    recall = gold_recall(spark, folder).agg(F.expr(_half_up("count_if(hit) / count(*)")).alias("actual")).select(F.lit("recall").alias("metric"), "actual")
    return A.against_targets(bench_metrics(spark, folder).unionByName(recall), spark.createDataFrame(TARGETS, "metric string, comparator string, target double"))


def fetch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Web fetches by how they ended: nothing came, too little to use, or text that can be evidence."""
    g = _grounding(spark, folder).where("kind = 'web'")
    how = F.expr("case when haystack_chars is null then 'cancelled' when haystack_chars = 0 then 'blocked' when haystack_chars < 300 then 'too_short' else 'ok' end").alias("outcome")
    return g.groupBy(how).agg(F.count("*").alias("n"), F.count_if(F.expr("length(trim(coalesce(snippet, ''))) > 80")).alias("admitted"), F.max("haystack_chars").alias("longest"))


def space_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """By space its documents and those indexed, beside the number of page parts of all spaces, which isn't counted by space."""
    d = table(spark, folder, "documents")
    every = d.agg(F.sum(F.expr("greatest(1, ceil(length(text) / 3000))")).alias("parts"))
    by = d.where("space_id is not null").groupBy("space_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "indexed").alias("indexed"))
    return by.crossJoin(F.broadcast(every))  # one row


def capability_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Over all citations: how many documents have a page, whether a request's id comes back, and whether counts agree."""
    g = records(table(spark, folder, "grounding_rows"), "rec_id", "request_id", "kind", "locator")
    r = records(table(spark, folder, "runs"), "run_id").select(F.col("run_id").alias("request_id"), F.lit(1).alias("known"))
    both = g.join(r, "request_id", "left")
    return both.agg(F.count_if(F.expr("kind = 'doc'")).alias("doc_citations"), F.count_if(F.expr("kind = 'doc' and locator.page is not null")).alias("with_page"), F.count("known").alias("request_known"), F.count("*").alias("citations"))


_LISTED = (
    factual_audit, misgrounded, call_pairs, known_candidates, ledger_sources, rendered_sources, source_locators, gold_recall, gold_placement, quality_rules, run_gates, deep_ratio, distinct_sources,
    snapshot_changes, ingest_ratio, workload, fetch_stops, sweep_candidates, rubric_scores, adjudicated, case_summary, run_fingerprints, thread_titles,
    search_then_fetch, markdown_sections, memory_blocks, trajectories, offered_tools, input_problems, redacted_props, public_sources, call_costs, bench_metrics,
    sla_report, fetch_outcomes, space_statistics, capability_checks,
)
QUERIES = {f.__name__: f for f in _LISTED}

# --- SQL -------------------------------------------------------------------------------------------------------------

R_ = latest("runs", "run_id")
Q_ = latest("quick_path", "record_id")
_bare = f"trim(regexp_replace(sentence, {a(A.MARKER)}, '', 'g'))"
_factual = f"(len(regexp_split_to_array({_bare}, {a(L.SPACE + '+')})) >= 6 and not regexp_matches({_bare}, {a(A.CUT_SHORT)}))"
_w3 = lambda t: f"list_distinct(regexp_extract_all(regexp_replace(lower({t}), {a(A.MARKER)}, ' ', 'g'), '[a-z0-9]{{3,}}'))"
_low = lambda x: f"lower(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
_up = lambda x: f"floor(({x}) * 1e6::double + 0.5::double) / 1e6::double"
_skey = "coalesce(url, 'doc:' || source_doc_id)"
_ledger = (
    f"(select request_id, source, row_number() over (partition by request_id order by pos, rec_id)::int as n, branches, seen from (select request_id, {_skey} as source, arg_min(source_position, (source_position, rec_id)) as pos, arg_min(rec_id, (source_position, rec_id)) as rec_id,"
    f" array_to_string(list_sort(list_distinct(list(citation))), ',') as branches, count(*) as seen from {G} where request_id is not null and {_skey} is not null group by 1, 2))"
)
_grounded6 = "case when len(t) = 0 then false when len(t) <= 6 then contains(hay, array_to_string(t, ' ')) else len(list_filter(range(1, len(t) - 4), lambda i: contains(hay, array_to_string(t[i:i + 5], ' ')))) > 0 end"
_gold = (
    f"{_bm}, top as (select item_id, doc_id from {_rk('bm', 'item_id', 'doc_id', 5)}), gh as (select item_id, bool_or({_grounded6}) as hit from (select top.item_id, {_pt('coalesce(e.anchor, ' + a('') + ')')} as t, array_to_string({_pt('d.text')}, ' ') as hay from top join eval_items e using (item_id) join documents d using (doc_id)) group by 1),"
    " gr as (select item_id, coalesce(hit, false) as hit from eval_items left join gh using (item_id))"
)
_lat = "floor(value * 10)"
_p95 = lambda where: f"(select quantile_disc({_lat}, 0.95) from events where {where})"
_metrics = (
    f"select 'latency_p95' as metric, {_p95('true')}::double as actual union all select 'error_rate', {_up(chr(99) + 'ount(*) filter (event_type = ' + a('error') + ')::double / count(*)')} from events"
    f" union all select 'grounding', {_up('count(*) filter (category = ' + a('provenance verified') + ')::double / count(*) filter (category <> ' + a('web page fetch blocked') + ')')} from {G}"
    f" union all select 'cache_hit_rate', {_up('count(*) filter (t.cached)::double / count(t.cached)')} from (select unnest(tools) as t from {Q_})"
)
_ordered = "list_sort(list_transform(list_filter(range(1, len(tool_calls) + 1), lambda i: tool_calls[i].step is not null), lambda i: {'s': tool_calls[i].step, 'i': i}))"
_z = stats.Z_95

SQL = {
    "factual_audit": f"select variant, count(*) as factual, count(*) filter (cited) as cited, count(*) filter (gap and not cited) as disclosures, max(best_support) filter (not cited) as best_uncited, count(*) - count(*) filter (gap and not cited) as excluding_disclosures"
    f" from (select *, regexp_matches(sentence, '\\[[0-9]') as cited, {_absent('sentence')} as gap from {M} where sentence is not null and {_factual}) group by 1",
    "misgrounded": f"with s as (select request_id as run_id, citation as n, arg_min(snippet, rec_id) filter (snippet is not null) as fs, arg_min(coalesce(snippet, ''), rec_id) as snippet from {G} where request_id is not null and citation is not null group by 1, 2), c as (select rec_id, run_id, rec_id % 7 + 1 as ref, coalesce(best_support, 0.0)::double as support, {_w3('sentence')} as c,"
    f" list_filter(regexp_extract_all(sentence, {a(A.FIGURE)}), lambda f: length(f) > 1) as figures from {M} where sentence is not null and run_id is not null), e as (select c.*, n, snippet, case when s.n is null then (case when len(c.c) = 0 then 1.0 end)::double when len(c.c) = 0 then 1.0::double else len(list_intersect(c.c, {_w3('snippet')}))::double / len(c.c) end as score from c left join s using (run_id)),"
    " b as (select rec_id, max(score) as score, arg_min(n, (-score, n)) as n, any_value(ref) as ref, any_value(support) as support, any_value(figures) as figures, count(*) filter (n = ref) as cited, max(snippet) filter (n = ref) as txt from e group by 1)"
    " select rec_id, case when cited = 0 then 'wrong_citation' when not coalesce(n = ref, false) and coalesce(score, 0) >= 0.6 and coalesce(score, 0) - support > 0.2 then 'wrong_citation' when len(list_filter(figures, lambda f: not contains(coalesce(txt, ''), f))) > 0 then 'model_overstatement' when support >= 0.35 then 'tokenization_false_negative'"
    " when coalesce(score, 0) < 0.5 then 'missing_passage_or_unsupported' else 'unclassified' end as category, case when score >= 0.6 and n <> ref then n end as better_source from b",
    "call_pairs": "select event_id, case when pk = 'call' then pe end as call_id, case when pk = 'call' then (us - pu) // 1000000 end as seconds from (select *, lag(kind) over w as pk, lag(event_id) over w as pe, lag(us) over w as pu from (select event_id, user_id, json_extract_string(props, '$.k')::int % 5 as tool, epoch_us(ts) as us, case event_type when 'click' then 'call' when 'purchase' then 'result' end as kind from events) where kind is not null window w as (partition by user_id, tool order by us, event_id)) where kind = 'result'",
    "known_candidates": f"select rec_id, request_id from {G} g where url is not null and request_id is not null and source_position > 3 and not exists (select 1 from {G} k where k.request_id = g.request_id and k.url = g.url and k.source_position <= 3)",
    "ledger_sources": f"select * from {_ledger}",
    "rendered_sources": f"select request_id, md5(left(t, 4500)) as digest, length(left(t, 4500))::int as characters, greatest(0, length(t) - 4500)::int as dropped from (select request_id, string_agg(snippet, chr(10) || '---' || chr(10) order by coalesce(longest_window, 0) desc, rec_id) as t from {G} where request_id is not null and snippet is not null group by 1)",
    "source_locators": "select doc_id, p as page, h as heading, doc_id || ':' || coalesce(p::varchar, '') || ':' || coalesce(h, '') || ':' as locator_key from (select doc_id, nullif(d, '')::int as p, case when d = '' then left(page_label, 200) end as h from (select doc_id, page_label, regexp_extract(page_label, '(?i)^(?:p[.] *|page +)?([0-9]+)', 1) as d from documents where page_label is not null))",
    "gold_recall": f"with {_gold} select * from gr",
    "gold_placement": f"with i as (select item_id, {_pt('anchor')} as t from eval_items), d as (select doc_id, ' ' || array_to_string({_pt('text')}, ' ') || ' ' as hay from documents where text is not null), h as (select item_id, count(*) as documents, min(doc_id) as first from i join d on contains(hay, ' ' || array_to_string(t, ' ') || ' ') where len(t) >= 12 group by 1)"
    " select item_id, coalesce(documents, 0) as documents, first, case when t is null or len(t) = 0 then 'missing' when len(t) < 12 then 'too short' when documents is null then 'nowhere' when documents > 1 then 'several' end as problem from i left join h using (item_id)",
    "quality_rules": f"with r as (select *, list_transform(coalesce(tool_calls, []), lambda c: {_low('c.name')}) as n from {R_}), s as (select run_id, max(k) as streak from (select run_id, count(*) as k from (select run_id, name, i - row_number() over (partition by run_id, name order by i) as g from (select run_id, c.name as name, i from (select run_id, unnest(range(1, len(tool_calls) + 1)) as i, unnest(tool_calls) as c from {R_}))) group by run_id, name, g) group by 1),"
    " x as (select count(*) as checked, count(*) filter (len(list_filter(tool_calls, lambda c: not c.ok and trim(coalesce(c.error, '')) = '')) > 0) as a1, count(*) filter (terminated is distinct from 'done') as a2, count(*) filter (streak > 4) as a3, count(*) filter (len(list_filter(n, lambda v: contains(v, 'websearch') or contains(v, 'fetchpage'))) = 0) as r1,"
    " count(*) filter (depth = 'quick' and len(list_filter(n, lambda v: contains(v, 'planresearch'))) > 0) as r2, count(*) filter (tokens > 180000) as b1, count(*) filter (wall_clock_sec > 240) as b2, count(*) filter (cost_usd > 0.35) as b3 from r left join s using (run_id)),"
    f" me as ({_metrics}), tg(metric, comparator, target) as (values " + ", ".join(f"('{m}', '{c}', {t}::double)" for m, c, t in TARGETS if t <= 1) + "), y as (" + " union all ".join(f"select '{n}' as rule, checked, {n.lower()} as failing from x" for n in ("A1", "A2", "A3", "R1", "R2", "B1", "B2", "B3"))
    + " union all select 'E1', count(*), case when count(*) < 30 then 1 else 0 end from eval_items union all select 'E2', count(*), count(*) filter (not case when comparator = '<=' then actual <= target else actual >= target end) from me join tg using (metric)) select *, failing = 0 as passes from y",
    "run_gates": f"with n as (select depth, list_transform({_ordered}, lambda x: coalesce({_low('tool_calls[x.i].name')}, '')) as n, coalesce(len(tool_calls), 0) as calls from {R_} where depth is not null), g as (select depth, count(*) as runs, max(calls)::int as most_calls,"
    " count(*) filter (case when depth = 'deep' then coalesce(len(n), 0) > 0 and contains(n[1], 'planresearch') else coalesce(len(list_filter(n, lambda x: contains(x, 'planresearch'))), 0) = 0 end) as plan, count(*) filter (calls <= case when depth = 'deep' then 24 else 8 end) as c from n group by 1)"
    " select depth, runs, most_calls, 'plan' as gate, plan as passing, plan = runs as pass from g union all select depth, runs, most_calls, 'calls', c, c = runs from g",
    "deep_ratio": f"with s as (select request_id as run_id, count(distinct {_skey}) as sources from {G} where request_id is not null group by 1), b as (select query, avg(sources) filter (depth = 'deep') as deep, avg(sources) filter (depth = 'quick') as quick from {R_} join s using (run_id) where query is not null and depth is not null group by 1)"
    f" select query, {_up('deep')} as deep, {_up('quick')} as quick, {_up('deep / quick')} as ratio from b where deep is not null and quick > 0",
    "distinct_sources": f"select request_id, count(distinct coalesce(url, source_doc_id || ':' || coalesce(locator.page::varchar, locator.heading, ''))) as sources, count(url) as web from {G} where request_id is not null group by 1",
    "snapshot_changes": "with d as (select distinct source, md5(text) as digest from documents where text is not null) select digest, case when bool_or(source = 'note') then 'added' else 'removed' end as change from d where source in ('memory', 'note') group by 1 having count(*) = 1",
    "ingest_ratio": f"select busy, idle, {_up('busy::double / idle')} as ratio from (select {_p95('hour(ts) % 2 = 0')}::bigint as busy, {_p95('hour(ts) % 2 = 1')}::bigint as idle)",
    "workload": "select i, item_id, i >= 160 as repeat from (select i, case when i < 160 then i else (i - 160) % 160 end + 1 as item_id from range(320) t(i))",
    "fetch_stops": f"with g as (select request_id, row_number() over (partition by request_id order by source_position, rec_id) as k, case when length(trim(coalesce(snippet, ''))) > 80 then coalesce(regexp_extract(url, '^https?://([^/?#:]*)', 1), 'doc:' || source_doc_id) end as site from {G} where request_id is not null),"
    " f as (select request_id, min(k) as k from g where site is not null group by request_id, site), s as (select request_id, min(k) as stop from (select request_id, k, row_number() over (partition by request_id order by k) as r from f) where r = 2 group by 1)"
    " select request_id, coalesce(any_value(stop), count(*))::bigint as attempts, any_value(stop)::int as stopped_at from g left join s using (request_id) group by 1",
    "sweep_candidates": f"with g as (select request_id, rec_id, source_position, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) as site from {G} where url is not null and request_id is not null)"
    " select request_id, site, k from (select request_id, site, row_number() over (partition by request_id order by pos, rid)::int as k from (select request_id, site, arg_min(source_position, (source_position, rec_id)) as pos, arg_min(rec_id, (source_position, rec_id)) as rid from g where source_position > 5 and (request_id, site) not in (select request_id, site from g where source_position <= 5) group by 1, 2)) where k <= 3",
    "rubric_scores": f"select run_id, passed, floor(passed / 3.0::double * 10 + 0.5)::int as points, case passed when 3 then 'pass' when 0 then 'fail' else 'partial' end as verdict from (select run_id, (coalesce(terminated = 'done', false)::int + (coalesce(len(tool_calls), 0) > 0)::int + (coalesce(len(list_filter(tool_calls, lambda c: not c.ok)), 0) = 0)::int)::int as passed from {R_})",
    "adjudicated": f"select *, {_up('artefacts::double / n')} as artefacts_rate, {_up('supported::double / n')} as supported_rate, {_up('unsupported::double / n')} as unsupported_rate from (select variant, count(*) as n, count(*) filter (art) as artefacts, count(*) filter (not art and best_support >= 0.5) as supported, count(*) filter (not art and coalesce(best_support, 0) < 0.5) as unsupported"
    f" from (select *, shape in ('list_introduction', 'quotation_fragment') as art from {M} where sentence is not null) group by 1)",
    "case_summary": f"with b as (select query, count(*) as n, count(*) filter (terminated = 'done')::double as k, count(*) filter (terminated = 'cap') as capped, count(*) filter (terminated = 'error') as failed, avg(wall_clock_sec) as m from {R_} where query is not null group by 1), w as (select *, k / n as p, {_z * _z}::double as zz from b)"
    f" select query, n, capped, failed, {_up('p')} as rate, {_up(f'greatest(0, (p + zz / (2 * n) - {_z}::double * sqrt(p * (1 - p) / n + zz / (4.0::double * n * n))) / (1 + zz / n))')} as low, {_up(f'least(1, (p + zz / (2 * n) + {_z}::double * sqrt(p * (1 - p) / n + zz / (4.0::double * n * n))) / (1 + zz / n))')} as high, {_up('m')} as mean_s from w",
    "run_fingerprints": f"select run_id, sha256(run_id || '|' || coalesce(query, '') || '|' || coalesce(depth, '') || '|' || coalesce(terminated, '')) as fingerprint from {R_}",
    "thread_titles": f"select thread_id, left(q, 80) as title, q || ' ' || year(c) as recent from (select thread_id, arg_min(query, (created_at, run_id)) as q, min(created_at) as c from {R_} where thread_id is not null and query is not null and created_at is not null group by 1)",
    "search_then_fetch": f"select run_id, coalesce(s > 0 and s < f, false) as in_order, terminated = 'cap' as capped from (select run_id, terminated, list_position(n, 's') as s, list_position(n, 'f') as f from (select run_id, terminated, list_transform(tool_calls, lambda c: case when contains({_low('c.name')}, 'websearch') then 's' when contains({_low('c.name')}, 'fetchpage') then 'f' else 'o' end) as n from {R_})) where f > 0",
    "markdown_sections": "select doc_id, (i - 1)::int as i, regexp_replace(h[i], '^\\s+|\\s+$', '', 'g') as heading from (select doc_id, h, unnest(range(1, len(h) + 1)) as i from (select doc_id, regexp_extract_all(text, '(?m)^#{1,4} +([^\\n\\r]+)', 1) as h from documents where text is not null))",
    "memory_blocks": f"select thread_id, '<turns>' || chr(10) || string_agg('- ' || left(query, 40), chr(10) order by created_at nulls first, run_id) || chr(10) || '</turns>' as block from {R_} where thread_id is not null and query is not null group by 1",
    "trajectories": f"select run_id, n::int as n, tool_calls[o[n].i].step as step, tool_calls[o[n].i].name as name, tool_calls[o[n].i].ok as ok from (select run_id, tool_calls, o, unnest(range(1, len(o) + 1)) as n from (select run_id, tool_calls, {_ordered} as o from {R_}))",
    "offered_tools": "select space_id, mode, mode <> 'docs' as web, mode <> 'web' and indexed > 0 as documents from (select space_id, count(*) filter (status = 'indexed') as indexed from documents where space_id is not null group by 1), (select unnest(['auto', 'docs', 'web']) as mode)",
    "input_problems": f"select * from (select run_id, concat_ws('; ', case when length(trim(coalesce(query, ''))) < 3 then 'query: too short' when length(trim(coalesce(query, ''))) > 40 then 'query: too long' end, case when depth is null or depth not in ('quick', 'deep') then 'depth: unknown' end) as problems from {R_}) where problems <> ''",
    "redacted_props": "select event_id, '{\"apiKey\": \"[redacted]\", \"inner\": {\"user_token\" : \"[redacted]\"}, \"rest\": ' || coalesce(props, 'null') || '}' as props from events",
    "public_sources": f"select request_id, n, source, split_part(branches, ',', 1) as branch, case when source like 'doc:%' then 'doc' else 'web' end as kind from {_ledger}",
    "call_costs": f"select depth, count(*) as runs, {_up('sum(coalesce(tokens, 0) * case when depth = ' + a('quick') + ' then 1.0::double else 3.0::double end + coalesce(tokens // 6, 0) * case when depth = ' + a('quick') + ' then 5.0::double else 15.0::double end) / 1e6::double')} as cost from {R_} group by 1",
    "bench_metrics": _metrics,
    "sla_report": f"with {_gold}, me as ({_metrics} union all select 'recall', {_up('count(*) filter (hit)::double / count(*)')} from gr), tg(metric, comparator, target) as (values " + ", ".join(f"('{m}', '{c}', {t}::double)" for m, c, t in TARGETS) + ")"
    " select tg.metric, comparator, target, actual, coalesce(case when comparator = '<=' then actual <= target else actual >= target end, false) as pass from tg left join me using (metric)",
    "fetch_outcomes": f"select case when haystack_chars is null then 'cancelled' when haystack_chars = 0 then 'blocked' when haystack_chars < 300 then 'too_short' else 'ok' end as outcome, count(*) as n, count(*) filter (length(trim(coalesce(snippet, ''))) > 80) as admitted, max(haystack_chars) as longest from {G} where kind = 'web' group by 1",
    "space_statistics": "select space_id, count(*) as documents, count(*) filter (status = 'indexed') as indexed, (select sum(greatest(1, ceil(length(text) / 3000.0)))::bigint from documents) as parts from documents where space_id is not null group by 1",
    "capability_checks": f"select count(*) filter (kind = 'doc') as doc_citations, count(*) filter (kind = 'doc' and locator.page is not null) as with_page, count(known) as request_known, count(*) as citations from (select kind, locator, k.run_id as known from {G} g left join (select distinct run_id from runs where run_id is not null) k on k.run_id = g.request_id)",
}
