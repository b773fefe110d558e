"""Queries of evidence checking: answers and their sources, snippets and their pages, coverage of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import literals as L
from groundwork.functions import text as T
from groundwork.functions import urls as U
from groundwork.functions.literals import ansi_text as a
from groundwork.functions.literals import spark_text as q
from groundwork.operators.paths import longest_prefix
from groundwork.plans import evidence as E
from groundwork.queries.text import _absent, _words, latest
from groundwork.runtime import broadcast_if_small, spread
from groundwork.sources.tables import records, table


def _grounding(spark: SparkSession, folder: str) -> DataFrame:
    return records(
        table(spark, folder, "grounding_rows"), "rec_id", "request_id", "query", "kind", "source_doc_id", "url", "source_position", "snippet", "haystack_chars", "longest_window", "category", "ran_at"
    )


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    """Cited answers against the four documents after each."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text", "source"), "doc_id")
    answers = d.where("source = 'answer' and text is not null").select("doc_id", "text")
    # which documents are sources of an answer is settled by ids, before any text moves
    wanted = answers.select("doc_id", F.explode(F.expr("transform(sequence(1, 4), n -> named_struct('at', doc_id + n, 'n', n))")).alias("p")).select("doc_id", "p.at", "p.n")
    sources = d.select(F.col("doc_id").alias("at"), F.col("text").alias("source_text")).join(broadcast_if_small(wanted), "at")
    return E.validated(answers, "doc_id", "text", sources.select("doc_id", "n", "source_text"), "n", "source_text")


def answer_validation(spark: SparkSession, folder: str) -> DataFrame:
    v = _validated(spark, folder)
    return v.select("doc_id", F.array_join("cited", ",").alias("cited"), F.array_join("invalid", ",").alias("invalid"), F.array_join("uncited", ",").alias("uncited"), "cited_sentences", "supported_sentences", "orphans", "freed", "groundedness")


def groundedness_summary(spark: SparkSession, folder: str) -> DataFrame:
    v = _validated(spark, folder)
    return v.agg(F.count("*").alias("answers"), F.sum("cited_sentences").alias("cited"), (F.sum("supported_sentences") / F.sum("cited_sentences")).alias("pooled"), F.avg("groundedness").alias("mean"))


def answer_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Of each answer the numbers that its markers name, those without a source (above 4), and the sources never named."""
    refs = f"array_sort(array_distinct(flatten(transform(regexp_extract_all(text, {q(L.CITATION)}, 1), g -> transform(split(g, ' *, *'), x -> cast(x as int))))))"
    d = table(spark, folder, "documents").where("source = 'answer' and text is not null").select("doc_id", F.expr(refs).alias("refs"))
    return d.select(
        "doc_id",
        F.array_join(F.expr("filter(refs, x -> x <= 4)"), ",").alias("cited"),
        F.array_join(F.expr("filter(refs, x -> x > 4)"), ",").alias("dangling"),
        F.array_join(F.expr("array_except(sequence(1, 4), refs)"), ",").alias("uncited"),
    )


def claim_support(spark: SparkSession, folder: str) -> DataFrame:
    """Every uncited sentence against all snippets of its run: the best share of its words that one of them has."""
    claims = records(table(spark, folder, "miss_shapes"), "rec_id", "run_id", "sentence").where("sentence is not null and run_id is not null")
    sources = _grounding(spark, folder).where("snippet is not null").select(F.col("request_id").alias("run_id"), "snippet")
    # words are taken on either side once, before the join
    claims = claims.select("rec_id", "run_id", F.expr(E.claim_words("sentence")).alias("c"))
    sources = sources.select("run_id", F.expr(T.content_words("snippet")).alias("w"))
    scored = claims.join(sources, "run_id").select("rec_id", F.expr("case when size(c) > 0 then size(array_intersect(c, w)) / size(c) end").alias("s"))
    return scored.groupBy("rec_id").agg(F.max("s").alias("best")).select("rec_id", F.expr("floor(best * 1000 + 0.5) / 1000").alias("best_support"))


def pooled_and_mean_support(spark: SparkSession, folder: str) -> DataFrame:
    """By variant: the share of supported sentences over all, and the mean of the runs' shares."""
    m = records(table(spark, folder, "miss_shapes"), "rec_id", "run_id", "variant", "best_support").where("best_support is not null")
    runs = m.groupBy("variant", "run_id").agg(F.count("*").alias("n"), F.count_if(F.col("best_support") >= 0.8).alias("k"))
    by = runs.groupBy("variant").agg(F.sum("n").alias("sentences"), (F.sum("k") / F.sum("n")).alias("pooled"), F.avg(F.col("k") / F.col("n")).alias("mean"))
    return by.select("variant", "sentences", *[F.expr(f"floor({c} * 1e6 + 0.5) / 1e6").alias(c) for c in ("pooled", "mean")])


def snippet_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Every citation's snippet sought in its document, or judged by the page's recorded match."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("source_doc_id"), "text")
    g = _grounding(spark, folder).join(d, "source_doc_id", "left")
    g = g.select("rec_id", "kind", "source_position", "snippet", "haystack_chars", F.expr("coalesce(longest_window, 0)").alias("lw"), F.expr(f"filter(split({E.spaced('coalesce(snippet, ' + q('') + ')')}, ' '), w -> w != '')").alias("t"), F.expr(E.spaced("coalesce(text, '')")).alias("hay"))
    g = g.withColumn("found", F.expr(f"coalesce({E.grounded('t', 'hay')}, false)")).withColumn("window", F.expr(f"case when kind = 'doc' then {E.longest_window('t', 'hay')} else lw end"))
    return g.select("rec_id", "found", "window", F.expr(E.provenance("kind", "found", "source_position", "haystack_chars", "window", "size(t)", "snippet")).alias("provenance"))


def provenance_summary(spark: SparkSession, folder: str) -> DataFrame:
    return snippet_provenance(spark, folder).groupBy("provenance").agg(F.count("*").alias("n"), F.max("window").alias("longest"))


def question_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Whether what a request read is enough: publishers, aggregators, the question's words, and dates for questions about now."""
    g = _grounding(spark, folder).where("request_id is not null")
    g = g.withColumn("usable", F.expr("length(trim(coalesce(snippet, ''))) > 80")).withColumn("publisher", F.expr(f"case when kind = 'doc' then concat('doc:', source_doc_id) else {U.publisher('url')} end"))
    asked = T.content_words("query", L.STOP_COVERAGE, 3)
    by = g.groupBy("request_id").agg(
        F.min("query").alias("query"),
        F.count_if("usable").alias("usable"),
        F.count_distinct(F.expr("case when usable then publisher end")).alias("publishers"),
        F.count_distinct(F.expr(f"case when usable and not publisher rlike {q(L.AGGREGATOR)} then publisher end")).alias("non_aggregators"),
        F.array_distinct(F.flatten(F.collect_set(F.expr(f"case when usable then {T.content_words('snippet', L.STOP_COVERAGE, 3)} end")))).alias("corpus"),
    )
    by = by.withColumn("term_coverage", F.expr(f"case when usable = 0 then 0D when size({asked}) = 0 then 1D else size(array_intersect({asked}, corpus)) / size({asked}) end"))
    ok = "(publishers = 1 and non_aggregators = 1 and term_coverage >= 0.75) or (publishers >= 2 and term_coverage >= 0.5 and non_aggregators >= 1)"
    return by.select("request_id", "usable", "publishers", "non_aggregators", F.expr("floor(term_coverage * 1000 + 0.5) / 1000").alias("term_coverage"), F.expr(f"query rlike {q(L.TIME_SENSITIVE)}").alias("about_now"), F.expr(ok).alias("ok"))


def retrieval_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Requests by where their retrieval went wrong: relevance from the recorded match, judgements from the run's sentences."""
    g = _grounding(spark, folder).where("request_id is not null")
    relevant = "coalesce(longest_window, 0) >= 10"
    by = g.groupBy(F.col("request_id").alias("run_id")).agg(
        F.count_if(F.expr(relevant)).alias("relevant"),
        F.count_if(F.expr(f"{relevant} and source_position <= 5")).alias("attempted"),
        F.min(F.expr(f"case when {relevant} then source_position end")).alias("best_rank"),
        F.max(F.expr("case when source_position <= 5 then source_position else 0 end")).alias("deepest_rank"),
        F.count_if(F.expr(f"{relevant} and source_position <= 5 and coalesce(haystack_chars, 0) >= 300")).alias("usable"),
        F.count_if(F.expr("haystack_chars is null")).alias("cancelled"),
        F.count("longest_window").alias("judged"),
    )
    m = records(table(spark, folder, "miss_shapes"), "rec_id", "run_id", "best_support", "variant").groupBy("run_id").agg(
        F.max(F.expr("best_support >= 0.6")).alias("contains_answer"), F.count("best_support").alias("cited"), F.count_if(F.expr("best_support >= 0.5")).alias("supported")
    )
    both = by.join(m, "run_id", "left").selectExpr(
        "*", "judged > 0 as reviewed", "coalesce(supported, 0) % 2 = 0 as stopped_on_coverage", "contains_answer as faithful", "true as addressed", "case when cited > 1 then supported > 1 else true end as complete"
    )
    return both.select("run_id", F.expr(E.outcome()).alias("outcome"))


def robots_longest(spark: SparkSession, folder: str) -> DataFrame:
    """Cited pages under rules taken from their sites: even folders are closed, one page of each in turn open."""
    g = _grounding(spark, folder).where("url is not null").select("rec_id", F.expr(U.host("url")).alias("host"), F.expr(U.path("url")).alias("path"))
    folders = g.select("host", F.expr("regexp_extract(path, '^/[^/]*', 0)").alias("prefix")).distinct()
    closed = folders.where("length(prefix) % 2 = 0").select("host", F.lit(1).alias("nth"), "prefix", F.lit(False).alias("allow"))
    opened = g.where("rec_id % 2 = 0").select("host", F.lit(2).alias("nth"), F.col("path").alias("prefix"), F.lit(True).alias("allow")).distinct()
    return longest_prefix(g, "rec_id", F.col("host"), F.col("path"), closed.unionByName(opened))


def refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Uncited sentences by variant: those that refuse or speak of missing evidence, and runs with nothing else."""
    m = records(table(spark, folder, "miss_shapes"), "rec_id", "run_id", "sentence", "variant").where("sentence is not null")
    m = m.withColumn("refuses", F.expr(T.refusal("sentence")))
    runs = m.groupBy("variant", "run_id").agg(F.count("*").alias("n"), F.count_if("refuses").alias("k"))
    return runs.groupBy("variant").agg(F.count("*").alias("runs"), F.sum("k").alias("refusing"), F.count_if(F.expr("k = n")).alias("full_refusals"), F.count_if(F.expr("k > 0 and k < n")).alias("partial"))


QUERIES = {
    f.__name__: f
    for f in (
        answer_validation, groundedness_summary, answer_citations, claim_support, pooled_and_mean_support, snippet_provenance, provenance_summary, question_coverage,
        retrieval_outcomes, robots_longest, refusals,
    )
}

G = latest("grounding_rows", "rec_id")
M = latest("miss_shapes", "rec_id")
_bracketed = "[\\[][0-9, ]+[\\]]"
_refs = f"list_distinct(flatten(list_transform(regexp_extract_all(text, {a(L.CITATION)}, 1), lambda g: list_transform(regexp_split_to_array(g, ' *, *'), lambda x: x::int))))"
_cw = lambda t: _words(t, L.STOP_COVERAGE, 3)
_sp = lambda t: f"trim(regexp_replace(lower({t}), {a(L.SPACE + '+')}, ' ', 'g'))"
_found = "case when len(t) = 0 then false when len(t) <= 12 then contains(hay, array_to_string(t, ' ')) else len(list_filter(range(1, len(t) - 10), lambda i: contains(hay, array_to_string(t[i:i + 11], ' ')))) > 0 end"
_long = "case when len(t) < 2 then 0 else coalesce(list_max(list_filter(range(2, least(12, len(t)) + 1), lambda n: len(list_filter(range(1, len(t) - n + 2), lambda i: contains(hay, array_to_string(t[i:i + n - 1], ' ')))) > 0)), 0) end"
_prov = (
    f"(select rec_id, found, w as window_, case when kind = 'doc' then case when found then 'verified' when source_position > 5 then 'beyond_top_five' else 'locator_missed' end when coalesce(haystack_chars, 0) = 0 then 'fetch_blocked' when found or w >= 12 then 'verified' when len(t) < 12 then 'snippet_short'"
    f" when w >= 6 then case when regexp_matches(snippet, '(?i)&[a-z#0-9]+;') then 'entity' else 'token_boundary' end when haystack_chars < 2000 then 'dynamic_page' else 'page_changed' end as provenance from (select *, {_found} as found, case when kind = 'doc' then {_long} else lw end as w"
    f" from (select rec_id, kind, source_position, snippet, haystack_chars, coalesce(longest_window, 0) as lw, list_filter(string_split({_sp('coalesce(snippet, ' + a('') + ')')}, ' '), lambda w: w <> '') as t, {_sp('coalesce(d.text, ' + a('') + ')')} as hay from {G} g left join documents d on d.doc_id = g.source_doc_id)))"
)
_host = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', '')"

SQL = {
    "answer_citations": f"select doc_id, array_to_string(list_sort(list_filter(r, lambda x: x <= 4)), ',') as cited, array_to_string(list_sort(list_filter(r, lambda x: x > 4)), ',') as dangling, array_to_string(list_filter([1, 2, 3, 4], lambda x: not list_contains(r, x)), ',') as uncited from (select doc_id, {_refs} as r from documents where source = 'answer' and text is not null)",
    "claim_support": f"select rec_id, floor(max(s) * 1000 + 0.5) / 1000 as best_support from (select m.rec_id, case when len(c) > 0 then len(list_intersect(c, w))::double / len(c) end as s from (select rec_id, run_id, {_words(f'regexp_replace(sentence, {a(_bracketed)}, {a(str())}, {a(chr(103))})', L.STOP_EVIDENCE)} as c from {M} where sentence is not null and run_id is not null) m"
    f" join (select request_id, {_words('snippet', L.STOP_EVIDENCE)} as w from {G} where snippet is not null) g on g.request_id = m.run_id) group by 1",
    "pooled_and_mean_support": f"select variant, sum(n)::bigint as sentences, floor(sum(k)::double / sum(n) * 1e6 + 0.5) / 1e6 as pooled, floor(avg(k::double / n) * 1e6 + 0.5) / 1e6 as mean from (select variant, run_id, count(*) as n, count(*) filter (best_support >= 0.8) as k from {M} where best_support is not null group by 1, 2) group by 1",
    "snippet_provenance": f'select rec_id, found, window_ as "window", provenance from {_prov}',
    "provenance_summary": f"select provenance, count(*) as n, max(window_) as longest from {_prov} group by 1",
    "question_coverage": f"with u as (select request_id, query, length(trim(coalesce(snippet, ''))) > 80 as usable, case when kind = 'doc' then 'doc:' || source_doc_id else array_to_string(string_split({_host}, '.')[-2:], '.') end as publisher, snippet from {G} where request_id is not null),"
    f" w as (select request_id, list_distinct(flatten(list({_cw('snippet')}))) as corpus from u where usable group by 1), b as (select request_id, min(query) as query, count(*) filter (usable) as usable, count(distinct publisher) filter (usable) as publishers, count(distinct publisher) filter (usable and not regexp_matches(publisher, {a(L.AGGREGATOR)})) as non_aggregators from u group by 1),"
    f" c as (select b.*, case when usable = 0 then 0.0::double when len({_cw('query')}) = 0 then 1.0::double else len(list_intersect({_cw('query')}, corpus))::double / len({_cw('query')}) end as tc from b left join w using (request_id))"
    f" select request_id, usable, publishers, non_aggregators, floor(tc * 1000 + 0.5) / 1000 as term_coverage, regexp_matches(query, {a(L.TIME_SENSITIVE)}) as about_now, (publishers = 1 and non_aggregators = 1 and tc >= 0.75) or (publishers >= 2 and tc >= 0.5 and non_aggregators >= 1) as ok from c",
    "retrieval_outcomes": f"with g as (select request_id as run_id, count(*) filter (coalesce(longest_window, 0) >= 10) as relevant, count(*) filter (coalesce(longest_window, 0) >= 10 and source_position <= 5) as attempted, min(source_position) filter (coalesce(longest_window, 0) >= 10) as best, max(case when source_position <= 5 then source_position else 0 end) as deepest,"
    f" count(*) filter (coalesce(longest_window, 0) >= 10 and source_position <= 5 and coalesce(haystack_chars, 0) >= 300) as usable, count(*) filter (haystack_chars is null) as cancelled, count(longest_window) as judged from {G} where request_id is not null group by 1), m as (select run_id, bool_or(best_support >= 0.6) as ans, count(best_support) as cited, count(*) filter (best_support >= 0.5) as sup from {M} group by 1)"
    " select run_id, case when judged = 0 then 'pending_review' when relevant = 0 then 'query_miss' when attempted = 0 and best > deepest then 'ranking_miss' when attempted = 0 then 'selection_miss' when usable = 0 then 'fetch_failure' when ans is null then 'pending_review' when not ans then 'passage_miss'"
    " when cited > 1 and sup <= 1 then 'synthesis_omission' when cited = 0 or sup < cited then 'citation_failure' else 'successful_retrieval' end as outcome from g left join m using (run_id)",
    "robots_longest": f"with g as (select rec_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) as host, coalesce(nullif(regexp_replace(url, '^[A-Za-z]+://[^/]*|[?#].*$', '', 'g'), ''), '/') as path from {G} where url is not null),"
    " r as (select distinct host, 1 as nth, regexp_extract(path, '^/[^/]*') as prefix, false as allow from g where length(regexp_extract(path, '^/[^/]*')) % 2 = 0 union all select distinct host, 2, path, true from g where rec_id % 2 = 0)"
    " select rec_id, coalesce((select arg_max(allow, (length(prefix), -nth)) from r where r.host = g.host and starts_with(g.path, r.prefix) and prefix <> ''), true) as allowed from g",
    "refusals": f"select variant, count(*) as runs, sum(k)::bigint as refusing, count(*) filter (k = n) as full_refusals, count(*) filter (k > 0 and k < n) as partial from (select variant, run_id, count(*) as n, count(*) filter ({_absent('sentence')} or {' or '.join(f'regexp_matches(sentence, {a(p)})' for p in L.REFUSAL)}) as k from {M} where sentence is not null group by 1, 2) group by 1",
}
