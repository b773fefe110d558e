"""Checks of runs, sources and answers: expressions and plans that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import literals as L
from groundwork.functions import text as T
from groundwork.functions.literals import spark_text as q
from groundwork.runtime import broadcast_if_small

# A notice that an answer was cut short, figures in a sentence, and keys whose values are secrets.
CUT_SHORT = r"(?i)^\*?_?(?:research was cut short|the answer was cut short)"
FIGURE = r"\b\d[\d.,]*%?\b"
SECRET = r"(?i)(authorization|api[_-]?key|token|secret|password|cookie)"
MARKER = r"\[[\d,\s]+\]"


def locator(label: str) -> str:
    """SQL: struct of page and heading that a label names: ``p. 3``, ``page 3`` or a number at its front is a page, other text a
    heading of at most 200 characters."""
    digits = f"regexp_extract({label}, {q('(?i)^(?:p[.] *|page +)?([0-9]+)')}, 1)"
    return f"named_struct('page', cast(nullif({digits}, '') as int), 'heading', case when {digits} = '' then left({label}, 200) end)"


def plain_words(text: str) -> str:
    """SQL: the distinct runs of three or more letters and digits, without citation markers."""
    return f"array_distinct(regexp_extract_all(regexp_replace(lower({text}), {q(MARKER)}, ' '), '[a-z0-9]{{3,}}', 0))"


def bare(sentence: str) -> str:
    return f"trim(regexp_replace({sentence}, {q(MARKER)}, ''))"


def factual(sentence: str) -> str:
    """SQL: whether a sentence states something: six words at least, and no notice that the answer was cut short."""
    return f"(size(split({bare(sentence)}, {q(L.SPACE + '+')})) >= 6 and not {bare(sentence)} rlike {q(CUT_SHORT)})"


def misgrounding(best_score: str, best_cited: str, cited: str, lone: str, support: str, figures: str, cited_text: str) -> str:
    """SQL: why a cited sentence isn't supported by what it cites. A source that covers it clearly better comes first, then claims
    that only all cited sources together cover, figures that no cited text has, and words that nearly suffice."""
    absent = f"exists({figures}, f -> not contains({cited_text}, f))"
    return (
        f"case when {cited} = 0 then 'wrong_citation' when not {best_cited} and {best_score} >= 0.6 and {best_score} - {support} > 0.2 then 'wrong_citation'"
        f" when {lone} then 'combined_source_claim' when {absent} then 'model_overstatement' when {support} >= 0.35 then 'tokenization_false_negative'"
        f" when {best_score} < 0.5 then 'missing_passage_or_unsupported' else 'unclassified' end"
    )


def redacted(json: str) -> str:
    """SQL: a JSON text whose string values under secret keys are replaced, at any depth."""
    return f"regexp_replace({json}, {q('(?i)(' + chr(34) + '[^' + chr(34) + ']*(?:authorization|api[_-]?key|token|secret|password|cookie)[^' + chr(34) + ']*' + chr(34) + ' *: *)' + chr(34) + '[^' + chr(34) + ']*' + chr(34))}, '$1\"[redacted]\"')"


def paired_calls(df: DataFrame, keys: list[str], order: list[str], kind: str, at: Column) -> DataFrame:
    """Results (kind 'result') with the call they belong to: the last 'call' of the same keys that no result has taken. A later
    call takes the place of one that is open, so it is the row just before. Rows of other kinds don't count; a result without
    an open call has none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    both = df.where(F.col(kind).isin("call", "result")).withColumn("_before", F.lag(F.struct(F.col(kind).alias("kind"), F.struct(*order).alias("call"), at.alias("at"))).over(w))
    opened = F.col("_before.kind") == "call"
    out = both.where(F.col(kind) == "result").withColumn("call", F.when(opened, F.col("_before.call"))).withColumn("waited", F.when(opened, at - F.col("_before.at")))
    return out.drop("_before")


def priced(df: DataFrame, model: str, amounts: list[str], prices: DataFrame) -> DataFrame:
    """df with ``cost``: its amounts (null is none) at the prices, per million, of its model. prices: model and one column per
    amount. A model that isn't listed costs what the dearest by the last amount does."""
    dearest = prices.select(F.max_by(F.struct(*amounts), F.struct(F.col(amounts[-1]), F.col("model"))).alias("dearest"))
    listed = prices.select(F.col("model").alias("_model"), F.struct(*amounts).alias("_listed"))
    with_prices = df.join(F.broadcast(listed), F.col(model) == F.col("_model"), "left").crossJoin(F.broadcast(dearest))  # one row
    price = F.coalesce("_listed", "dearest")
    cost = sum((F.coalesce(F.col(a), F.lit(0)) * price[a] for a in amounts[1:]), F.coalesce(F.col(amounts[0]), F.lit(0)) * price[amounts[0]])
    return with_prices.withColumn("cost", cost / 1e6).drop("_model", "_listed", "dearest")


def against_targets(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (metric, comparator, target) with what was measured (metric, actual); without a value a target is missed."""
    met = F.when(F.col("comparator") == "<=", F.col("actual") <= F.col("target")).otherwise(F.col("actual") >= F.col("target"))
    return targets.join(measured, "metric", "left").withColumn("pass", F.coalesce(met, F.lit(False)))


def ledger(df: DataFrame, run: str, source: Column, branch: Column, order: list[str]) -> DataFrame:
    """(run, source, n, branches, seen, first): the distinct sources of each run, numbered by first appearance in the given order,
    with the branches that found them and how often they were seen. Null sources are left out."""
    found = df.withColumn("_source", source).where("_source is not null")
    each = found.groupBy(run, "_source").agg(F.min(F.struct(*order)).alias("first"), F.array_sort(F.collect_set(branch)).alias("branches"), F.count("*").alias("seen"))
    n = F.row_number().over(Window.partitionBy(run).orderBy("first"))
    return each.select(run, F.col("_source").alias("source"), n.alias("n"), "branches", "seen", "first")


def rendered(df: DataFrame, key: str, order: list[Column], text: str, most: int = 4500, join: str = "\n---\n") -> DataFrame:
    """(key, shown, dropped): each key's passages in order as one text of at most so many characters, and how many it leaves out."""
    ordered = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(text).alias("t"))))
    by = df.where(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), join).alias("all"))
    return by.select(key, F.expr(f"left(all, {most})").alias("shown"), F.expr(f"greatest(0, length(all) - {most})").alias("dropped"))


def first_enough(df: DataFrame, key: str, order: list[str], usable: str, group: str, least: int = 2) -> DataFrame:
    """(key, attempts, stopped_at): where reading in order may stop, at the first row by which usable rows of so many groups are
    read; null if that is never so, and everything was attempted."""
    w = Window.partitionBy(key).orderBy(*order)
    read = df.withColumn("_k", F.row_number().over(w)).withColumn("_new", F.row_number().over(Window.partitionBy(key, usable, group).orderBy(*order)))
    groups = F.count_if(F.col(usable) & F.col(group).isNotNull() & (F.col("_new") == 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    by = read.withColumn("_groups", groups).groupBy(key).agg(F.count("*").alias("all"), F.min(F.when(F.col("_groups") >= least, F.col("_k"))).alias("stopped_at"))
    return by.select(key, F.coalesce("stopped_at", "all").alias("attempts"), "stopped_at")


def snapshot_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): what one snapshot has and the other doesn't, by one full join."""
    a, b = before.select(key, F.lit(True).alias("was")).distinct(), after.select(key, F.lit(True).alias("is_")).distinct()
    both = a.join(b, key, "full_outer").where("was is null or is_ is null")
    return both.select(key, F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"))


def award(passed: str, parts: str, points: int) -> str:
    """SQL: struct of the points for passed of so many parts, rounded half up, and the verdict."""
    return (
        f"named_struct('points', int(floor({passed} / {parts} * {points} + 0.5)), 'verdict',"
        f" case when {passed} = {parts} then 'pass' when {passed} = 0 then 'fail' else 'partial' end)"
    )


def incoherent(budget: dict[str, float], thresholds: dict[str, float], required: set[str], forbidden: set[str]) -> list[str]:
    """What can't be meant in declared expectations: bounds that aren't positive, shares outside 0 to 1, and tools that must and
    must not be called."""
    problems = [f"budget.{k} must be a positive number" for k, v in sorted(budget.items()) if not isinstance(v, (int, float)) or isinstance(v, bool) or v <= 0]
    problems += [f"{k} is outside 0..1" for k, v in sorted(thresholds.items()) if not isinstance(v, (int, float)) or not 0 <= v <= 1]
    return problems + [f"{t} is both required and forbidden" for t in sorted(required & forbidden)]


def placed(items: DataFrame, key: str, passage: str, documents: DataFrame, document: str, text: str, least: int = 12) -> DataFrame:
    """(key, documents, first, problem): how many documents hold an item's whole passage, word for word in plain tokens, and the
    first of them. Candidates share the hash of the passage's first words; only these are compared in full. Passages of fewer
    than least words are too short to be placed; null ones are missing."""
    tokens = items.select(key, F.expr(T.plain_tokens(passage)).alias("t"))
    heads = tokens.where(f"size(t) >= {least}").select(key, F.expr(f"xxhash64(array_join(slice(t, 1, {least}), ' '))").alias("h"), F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("p"))
    words = documents.where(F.col(text).isNotNull()).select(F.col(document).alias("_d"), F.expr(T.plain_tokens(text)).alias("t")).where(f"size(t) >= {least}")
    each = words.select("_d", F.explode(F.expr(f"array_distinct(transform(sequence(0, size(t) - {least}), i -> xxhash64(array_join(slice(t, i + 1, {least}), ' '))))")).alias("h"))
    candidates = each.join(broadcast_if_small(heads, "p"), "h")
    full = words.select("_d", F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("hay"))
    held = candidates.select(key, "_d", "p").join(full, "_d").where("contains(hay, p)").groupBy(key).agg(F.count("*").alias("documents"), F.min("_d").alias("first"))
    both = tokens.join(held, key, "left")
    problem = F.when(F.col("t").isNull() | (F.size("t") == 0), "missing").when(F.size("t") < least, "too short").when(F.col("documents").isNull(), "nowhere").when(F.col("documents") > 1, "several")
    return both.select(key, F.coalesce("documents", F.lit(0)).alias("documents"), "first", problem.alias("problem"))


def sections(text: str) -> str:
    """SQL: the headings of levels 1 to 4 of a marked-up text, in order."""
    return f"regexp_extract_all({text}, {q('(?m)^#{1,4} +([^' + chr(92) + 'n' + chr(92) + 'r]+)')}, 1)"
