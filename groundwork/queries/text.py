"""Queries over text and URL functions, on documents, questions, sentences and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import literals as L
from groundwork.functions import text as T
from groundwork.functions import urls as U
from groundwork.functions.literals import ansi_text as a
from groundwork.functions.literals import ansi_words
from groundwork.runtime import spread
from groundwork.sources.tables import records, table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").where("text is not null").select("doc_id", "text"), "doc_id")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Every document beside the question whose number it has, counted round."""
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("i"), "question")
    docs = _documents(spark, folder).withColumn("i", F.expr("pmod(doc_id, 320) + 1"))
    return docs.join(items, "i").drop("i")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return records(table(spark, folder, "runs"), "run_id", "query", "thread_id", "depth", "created_at").where("query is not null")


def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.expr(T.tokens("text")).alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


def text_content_words(spark: SparkSession, folder: str) -> DataFrame:
    """The three stop lists side by side."""
    lists = {"evidence": (L.STOP_EVIDENCE, 2), "ordering": (L.STOP_ORDER, 2), "coverage": (L.STOP_COVERAGE, 3)}
    return _documents(spark, folder).select(
        "doc_id", *[F.expr(f"array_join(array_sort({T.content_words('text', words, least)}), ' ')").alias(n) for n, (words, least) in lists.items()]
    )


def text_cache_key(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("run_id", F.expr(T.cache_key("query")).alias("cache_key"))


def text_plan_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("run_id", F.expr(T.plan_fingerprint("query")).alias("fingerprint"))


def text_search_query(spark: SparkSession, folder: str) -> DataFrame:
    asked = _questions(spark, folder).withColumn("query", F.concat(F.lit("Could you, please tell me  "), F.col("query")))
    return asked.select("run_id", F.expr(T.search_query("query")).alias("search_query"), F.expr(T.broadened("query")).alias("broadened"))


def passage_features(spark: SparkSession, folder: str) -> DataFrame:
    asked = _asked(spark, folder).withColumn("t", F.expr(T.tokens("text"))).withColumn("q", F.expr(T.tokens("question")))
    f = asked.select(
        "doc_id",
        F.expr(T.coverage_of("t", "q")).alias("query_coverage"),
        F.expr(T.prosiness_of("text", "t")).alias("prosiness"),
        F.expr(T.fragment_ratio("text")).alias("fragment_ratio"),
        F.expr(T.structured("text")).alias("structured"),
        F.length("text").alias("chars"),
    )
    navigation = "fragment_ratio >= 0.6 and not structured and query_coverage < 0.6"
    rounded = [F.expr(f"floor({c} * 1000 + 0.5) / 1000").alias(c) for c in ("query_coverage", "prosiness", "fragment_ratio")]
    return f.select("doc_id", *rounded, "structured", "chars", F.expr(navigation).alias("navigation_like"))


def passage_order(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a space in three orders for the space's question: as stored, by relevance, and content first."""
    docs = table(spark, folder, "documents").where("text is not null and space_id is not null").select("doc_id", "text", "space_id")
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("i"), "question")
    docs = docs.withColumn("i", F.expr("pmod(length(space_id) + ascii(right(space_id, 1)), 320) + 1")).join(items, "i")
    f = docs.select(
        "space_id",
        "doc_id",
        F.expr(T.coverage("text", "question")).alias("c"),
        F.expr(f"{T.fragment_ratio('text')} >= 0.6 and not {T.structured('text')}").alias("menu"),
    ).withColumn("nav", F.expr("menu and c < 0.6"))
    return f.select(
        "space_id",
        "doc_id",
        F.expr("row_number() over (partition by space_id order by c desc, doc_id)").alias("by_relevance"),
        F.expr("row_number() over (partition by space_id order by nav, c desc, doc_id)").alias("content_first"),
    )


def citation_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.expr(f"array_join({T.citation_numbers('text')}, ',')").alias("numbers")).where("numbers != ''")


def sentence_shapes(spark: SparkSession, folder: str) -> DataFrame:
    s = records(table(spark, folder, "miss_shapes"), "rec_id", "sentence", "best_support")
    return s.select("rec_id", F.expr(T.shape("sentence")).alias("shape_of"), F.expr(T.absence_claim("coalesce(sentence, '')")).alias("absence"))


def shape_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_shapes(spark, folder).groupBy("shape_of").agg(F.count("*").alias("n"), F.count_if("absence").alias("n_absence"))


def question_routes(spark: SparkSession, folder: str) -> DataFrame:
    q = _questions(spark, folder)
    turns = "coalesce(row_number() over (partition by thread_id order by created_at, run_id), 1) - 1"
    q = q.withColumn("turns", F.expr(f"case when thread_id is null then 0 else {turns} end"))
    q = q.withColumn("mode", F.expr("case when depth = 'deep' then 'web' else 'auto' end")).withColumn("space", F.expr("case when query like 'Compare%' then thread_id end"))
    return q.select("run_id", F.expr(T.question_kind("query", "mode", "space", "true", "turns")).alias("kind"))


def memory_contents(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "documents").where("source = 'memory' and text is not null")
    return m.select("doc_id", F.expr(T.memory_content("text")).alias("content"))


def usable_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.expr(T.usable_rewrite("text")).alias("rewrite"))


def stripped_markup(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).where("text like '%<%'").select("doc_id", F.expr(T.without_markup("text")).alias("plain"))


def url_forms(spark: SparkSession, folder: str) -> DataFrame:
    g = records(table(spark, folder, "grounding_rows"), "rec_id", "url").where("url is not null")
    g = g.withColumn("url", F.expr("concat(regexp_replace(url, '#.*', ''), '?utm_source=x&q=', rec_id % 7, '&gclid=1#part')"))
    return g.select(
        "rec_id",
        F.expr(U.canonical("url")).alias("url"),
        F.expr(U.domain("url")).alias("domain"),
        F.expr(U.publisher("url")).alias("publisher"),
        F.expr(U.last_two_labels("url")).alias("site"),
        F.expr(U.forbidden("url")).alias("forbidden"),
    )


def search_results(spark: SparkSession, folder: str) -> DataFrame:
    """Of equal pages within one request the first, in rank order; titles and snippets cut to size."""
    g = records(table(spark, folder, "grounding_rows"), "rec_id", "url", "request_id", "source_position", "snippet").where("url is not null")
    g = g.withColumn("clean", F.expr(U.canonical("url"))).where("clean is not null")
    first = "row_number() over (partition by request_id, clean order by source_position, rec_id)"
    g = g.withColumn("k", F.expr(first)).where("k = 1")
    plain = T.trimmed(f"regexp_replace(coalesce(snippet, ''), {L.spark_text(L.SPACE + '+')}, ' ')")
    return g.select("request_id", F.col("clean").alias("url"), F.expr(U.domain("clean")).alias("domain"), F.expr(f"left({plain}, 600)").alias("snippet"))


def paginated(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", F.expr(f"inline({T.pages('text')})"))
    return d.select("doc_id", "page", "label", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def line_at(spark: SparkSession, folder: str) -> DataFrame:
    """The line on which a document's second half begins."""
    return _documents(spark, folder).select("doc_id", F.expr("1 + regexp_count(left(text, cast(length(text) div 2 as int)), '\\n')").alias("line"))


def doc_language_status(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by language as declared, in one case, and by public status."""
    kind = "case status when 'indexed' then 'ready' when 'failed' then 'failed' when 'queued' then 'queued' else 'processing' end"
    d = table(spark, folder, "documents").select(F.expr("lower(lang)").alias("lang"), F.expr(kind).alias("status"))
    return d.groupBy("lang", "status").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        text_tokens, text_content_words, text_cache_key, text_plan_fingerprint, text_search_query, passage_features, passage_order, citation_numbers,
        sentence_shapes, shape_histogram, question_routes, memory_contents, usable_rewrites, stripped_markup, url_forms, search_results, paginated, line_at,
        doc_language_status,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------

S = L.SPACE
SX = S.replace("﻿", "\\x{FEFF}")


def _tok(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), {a(L.TOKEN)}), lambda x: length(x) between 2 and 39)"


def _words(t: str, stop: str, least: int = 2) -> str:
    return f"list_distinct(list_filter({_tok(t)}, lambda x: length(x) >= {least} and not list_contains({ansi_words(stop)}, x)))"


def _tr(t: str) -> str:
    return f"regexp_replace({t}, {a('^' + S + '+|' + S + '+$')}, '', 'g')"


def latest(name: str, key: str) -> str:
    return f"(select * from (select *, row_number() over (partition by {key} order by ingested_at desc) as rn_ from {name} where {key} is not null) where rn_ = 1)"


def _absent(t: str) -> str:
    bracketed = "[\\[][0-9," + S[1:-1] + "]+[\\]]"
    plain = f"regexp_replace(regexp_replace({t}, {a(bracketed)}, ' ', 'g'), {a(S + '+')}, ' ', 'g')"
    return "(" + " or ".join(f"regexp_matches({plain}, {a(p)})" for p in L.ABSENCE) + ")"


def _cov(passage: str, question: str) -> str:
    q, p = _words(question, L.STOP_ORDER), _words(passage, L.STOP_ORDER)
    return f"case when len({q}) = 0 then 0.0 else len(list_intersect({q}, {p}))::double / len({q}) end"


def _prose(t: str) -> str:
    w = _tok(t)
    ends = f"len(regexp_extract_all({t}, {a('[.!?](?:' + S + '|$)')}))"
    return (
        f"case when len({w}) < 4 then 0.5 else 0.7::double * least(1.0::double, len(list_filter({w}, lambda x: list_contains({ansi_words(L.STOP_ORDER)}, x)))::double / len({w}) / 0.3::double)"
        f" + 0.3::double * least(1.0::double, {ends}::double / greatest(1.0::double, len({w})::double / 100.0::double) / 4.0::double) end"
    )


def _frag(t: str) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array({t}, '\\n+'), lambda x: {_tr('x')}), lambda x: length(x) > 1)"
    pattern = "[.!?][\"')\\]]*$"
    short = f"list_filter({lines}, lambda x: length(x) < 90 and not regexp_matches(x, {a(pattern)}))"
    return f"case when len({lines}) = 0 then 0.0 else len({short})::double / len({lines}) end"


def _struct(t: str) -> str:
    ops = "[=<>×*/+%]|\\bbytes\\b|\\bms\\b|\\bGB\\b|\\bKB\\b"
    return f"(len(regexp_extract_all({t}, '[0-9]'))::double / greatest(1, length({t})) > 0.02 or len(regexp_extract_all({t}, {a(ops)})) >= 2)"


def _shape(t: str) -> str:
    tests = {n: f"regexp_matches({t if n in ('list_item', 'formula_or_spec', 'quotation_fragment') else _tr(t)}, {a(p)})" for n, p in L.SHAPES.items()}
    tests["evidence_gap_disclosure"] = f"({_absent(t)} or regexp_matches({t}, {a(L.SHAPES['evidence_gap_disclosure'])}))"
    tests["quotation_fragment"] += f" and not regexp_matches({_tr(t)}, {a('^[' + chr(34) + '“]')})"
    return "case " + " ".join(f"when {x} then '{n}'" for n, x in tests.items()) + " else 'continuation_prose' end"


DOCS = "(select doc_id, text from documents where text is not null)"
ASKED = f"(select d.doc_id, d.text, e.question from {DOCS} d join eval_items e on e.item_id = d.doc_id % 320 + 1)"
RUNS = f"(select * from {latest('runs', 'run_id')} where query is not null)"


def _named(t: str) -> str:
    first, rest = f"regexp_split_to_array({_tr(t)}, {a(S + '+')})[1]", f"regexp_replace({_tr(t)}, {a('^[^' + S[1:-1] + ']*')}, '')"
    quoted = "[\"'][^\"']{4,}[\"']"
    return (
        f"((regexp_matches({first}, '^[A-Z][a-zA-Z]{{2,}}') and not regexp_matches({first}, {a(L.OPENER_WORD)})) or regexp_matches({rest}, '[A-Z][a-zA-Z]{{2,}}')"
        f" or regexp_matches({t}, '[0-9]') or regexp_matches({t}, '(?i)[a-z]+[-.][a-z]+') or regexp_matches({t}, {a(quoted)}))"
    )


def _host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


_possessive, _junk = "['’]s\\b", "[^a-z0-9" + S[1:-1] + "]+"
_key_words = (
    f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(query), {a(_possessive)}, '', 'g'), {a(_junk)}, ' ', 'g'), {a(S + '+')}),"
    f" lambda w: w <> '' and not list_contains({ansi_words(L.STOP_CACHE)}, w))"
)
_plan_words = (
    f"list_filter(regexp_split_to_array(regexp_replace(lower(query), {a(_junk[:-1])}, ' ', 'g'), {a(S + '+')}), lambda w: length(w) > 2 and not list_contains({ansi_words(L.STOP_PLAN)}, w))"
)
_sq = _tr(f"regexp_replace(regexp_replace(query, {a(L.POLITE)}, ''), {a(S + '+')}, ' ', 'g')")
_kind_t = "query_t"
_quote_ends = "^[\"'`]|[\"'`]$"
_line = _tr(f"regexp_split_to_array(regexp_replace({_tr('text')}, {a(_quote_ends)}, '', 'g'), '\\n')[1]")
_mem_t = _tr("text")

SQL = {
    "text_tokens": f"select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens from (select doc_id, {_tok('text')} as t from {DOCS})",
    "text_content_words": f"select doc_id, array_to_string(list_sort({_words('text', L.STOP_EVIDENCE)}), ' ') as evidence, array_to_string(list_sort({_words('text', L.STOP_ORDER)}), ' ') as ordering,"
    f" array_to_string(list_sort({_words('text', L.STOP_COVERAGE, 3)}), ' ') as coverage from {DOCS}",
    "text_cache_key": f"select run_id, array_to_string(list_sort(list_distinct(list_transform({_key_words}, lambda w: case when length(w) > 3 and w like '%s' and w not like '%ss' then left(w, length(w) - 1) else w end))), ' ') as cache_key from {RUNS}",
    "text_plan_fingerprint": f"select run_id, array_to_string(list_sort({_plan_words}), ' ') as fingerprint from {RUNS}",
    "text_search_query": f"select run_id, left(s, 300) as search_query, array_to_string(regexp_split_to_array(regexp_replace(left(s, 300), '[?!.]', '', 'g'), {a(S + '+')})[1:12], ' ') as broadened"
    f" from (select run_id, {_sq} as s from (select run_id, 'Could you, please tell me  ' || query as query from {RUNS}))",
    "passage_features": "select doc_id, floor(c * 1000 + 0.5) / 1000 as query_coverage, floor(p * 1000 + 0.5) / 1000 as prosiness, floor(f * 1000 + 0.5) / 1000 as fragment_ratio, s as structured, chars,"
    f" f >= 0.6 and not s and c < 0.6 as navigation_like from (select doc_id, {_cov('text', 'question')} as c, {_prose('text')} as p, {_frag('text')} as f, {_struct('text')} as s, length(text) as chars from {ASKED})",
    "passage_order": "select space_id, doc_id, row_number() over (partition by space_id order by c desc, doc_id) as by_relevance, row_number() over (partition by space_id order by (menu and c < 0.6), c desc, doc_id) as content_first"
    f" from (select d.space_id, d.doc_id, {_cov('d.text', 'e.question')} as c, ({_frag('d.text')} >= 0.6 and not {_struct('d.text')}) as menu from documents d join eval_items e on e.item_id = (length(d.space_id) + ascii(right(d.space_id, 1))) % 320 + 1 where d.text is not null and d.space_id is not null)",
    "citation_numbers": f"select * from (select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {a(L.SINGLE_CITATION)}, 1), lambda x: x::int))), ',') as numbers from {DOCS}) where numbers <> ''",
    "sentence_shapes": f"select rec_id, {_shape('s')} as shape_of, {_absent('s')} as absence from (select rec_id, coalesce(sentence, '') as s from {latest('miss_shapes', 'rec_id')})",
    "shape_histogram": f"select shape_of, count(*) as n, count(*) filter (absence) as n_absence from (select {_shape('s')} as shape_of, {_absent('s')} as absence from (select coalesce(sentence, '') as s from {latest('miss_shapes', 'rec_id')})) group by 1",
    "question_routes": f"select run_id, case when {' or '.join(f'regexp_matches(t, {a(p)})' for p in L.MEMORY_INSTRUCTION)} then 'memory_instruction' when (space is not null and mode <> 'web') then 'documents'"
    f" when turns > 0 and (regexp_matches(t, {a(L.BACK_REFERENCE)}) or ((len(list_filter(regexp_split_to_array(t, {a(S + '+')}), lambda w: w <> '')) <= 4 or regexp_matches(t, {a(L.REFERENTIAL_OPENER)}) or regexp_matches(t, {a(L.DANGLING_REFERENCE)})) and not {_named('t')})) then 'contextual_follow_up' else 'standalone_web' end as kind"
    f" from (select run_id, coalesce({_tr('query')}, '') as t, case when depth = 'deep' then 'web' else 'auto' end as mode, case when query like 'Compare%' then thread_id end as space,"
    f" case when thread_id is null then 0 else row_number() over (partition by thread_id order by created_at nulls first, run_id) - 1 end as turns from {RUNS})",
    "memory_contents": "select doc_id, case when length(y) < 3 or (length(y) < 12 and y not like '% %') then null else y end as content from (select doc_id, regexp_replace(regexp_replace("
    + _tr("x")
    + f", {a(S + '+')}, ' ', 'g'), '^[,:;-][ ]*', '') as y from (select doc_id, case when regexp_matches(t, {a(L.IMPERATIVE)}) and not regexp_matches(t, {a(L.MEMORY_INSTRUCTION[3])}) then case when regexp_replace(t, '^[^:]{{0,80}}:[ \\n\\r\\t]*', '') <> t and {_tr(chr(114) + 'egexp_replace(t, ' + a('^[^:]{0,80}:[ ' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 't]*') + ', ' + a('') + ')')} <> ''"
    f" then regexp_replace(t, '^[^:]{{0,80}}:[ \\n\\r\\t]*', '') else regexp_replace(t, {a(L.IMPERATIVE)}, '') end else t end as x from (select doc_id, {_mem_t} as t from documents where source = 'memory' and text is not null)))",
    "usable_rewrites": f"select doc_id, case when l = '' or length(l) > 300 or regexp_matches(l, {a(L.CHATTY)}) then null else l end as rewrite from (select doc_id, {_line} as l from {DOCS})",
    "stripped_markup": "select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g') as plain from documents where text like '%<%'",
    "url_forms": "select rec_id, u || case when regexp_matches(u, '^https?://[^/]+$') then '/' else '' end || '?q=' || (rec_id % 7) as url, regexp_replace(h, '^www\\.', '') as domain,"
    " array_to_string(string_split(regexp_replace(h, '^www\\.', ''), '.')[-2:], '.') as publisher, array_to_string(string_split(h, '.')[-2:], '.') as site, false as forbidden"
    f" from (select rec_id, u, {_host('u')} as h from (select rec_id, regexp_replace(url, '[?#].*', '') as u from {latest('grounding_rows', 'rec_id')} where url is not null))",
    "search_results": f"select request_id, url, regexp_replace({_host('url')}, '^www\\.', '') as domain, left({_tr(f'regexp_replace(coalesce(snippet, {a(str())}), {a(S + chr(43))}, {a(chr(32))}, {a(chr(103))})')}, 600) as snippet from (select *, row_number() over (partition by request_id, url order by source_position, rec_id) as k"
    f" from (select rec_id, request_id, source_position, snippet, regexp_replace(url, '[?#].*', '') as url from {latest('grounding_rows', 'rec_id')} where url is not null)) where k = 1",
    "paginated": f"select doc_id, i + 1 as page, 'section ' || (i + 1) as label, length(substr(t, i * 3000 + 1, 3000)) as chars, md5(substr(t, i * 3000 + 1, 3000)) as digest from (select doc_id, t, unnest(range(0, greatest(1, ceil(length(t) / 3000.0)::int))) as i"
    f" from (select doc_id, {_tr('regexp_replace(regexp_replace(replace(coalesce(text, ' + a('') + '), chr(13) || chr(10), chr(10)), ' + a('[ ' + chr(92) + 't]+') + ', ' + a(' ') + ', ' + a('g') + '), ' + a(chr(92) + 'n{3,}') + ', chr(10) || chr(10), ' + a('g') + ')')} as t from documents))",
    "line_at": f"select doc_id, 1 + length(h) - length(replace(h, chr(10), '')) as line from (select doc_id, left(text, length(text) // 2) as h from {DOCS})",
    "doc_language_status": "select lower(lang) as lang, case status when 'indexed' then 'ready' when 'failed' then 'failed' when 'queued' then 'queued' else 'processing' end as status, count(*) as n from documents group by 1, 2",
}
