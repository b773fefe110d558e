"""Answers against their sources: sentences with the citations that belong to them, what each is supported by, and outcomes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import literals as L
from groundwork.functions import text as T
from groundwork.functions.literals import spark_text as q

SUPPORTED = 0.5

# Where blocks and sentences of a marked-up answer end, and what opens a block.
_BLOCK_END = re.compile(r"\n{2,}|\n(?=\s*(?:[-*+]|\d+[.)])\s)")
_SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*[*_]*\s+(?=[*_#>\-]*\s*[A-Z0-9\"'(\[])")
_OPENING_MARKERS = re.compile(r"(?:\[\d+(?:\s*,\s*\d+)*\]\s*)+")
_CLOSING_MARKER = re.compile(r"\[\d+(?:\s*,\s*\d+)*\][\"')\]]*[.!?]?[*_]*$")
_BLOCK_OPENER = re.compile(r"^\s*(?:[-*+]|\d+[.)]|#{1,6}|>)\s*")
_CITATION = re.compile(L.CITATION)
_ABSENCE = [re.compile(p) for p in L.ABSENCE]
_TOKEN = re.compile(L.TOKEN)
_STOP = frozenset(L.STOP_EVIDENCE.split())


@dataclass(frozen=True)
class Sentence:
    text: str
    block: int
    start: int
    end: int
    orphan: bool = False


def content_words(text: str) -> set[str]:
    return {t for t in _TOKEN.findall(text.lower()) if 2 <= len(t) <= 39 and t not in _STOP}


def about_evidence(sentence: str) -> bool:
    plain = re.sub(r"\s+", " ", re.sub(r"\[[\d,\s]+\]", " ", sentence))
    return any(p.search(plain) for p in _ABSENCE)


def leads(text: str) -> bool:
    """Whether an answer's blocks open with their markers more often than they close with them."""
    bodies = [_BLOCK_OPENER.sub("", b.strip()) for b in _BLOCK_END.split(text)]
    opening = sum(bool(_OPENING_MARKERS.match(b)) for b in bodies if b)
    closing = sum(bool(_CLOSING_MARKER.search(b)) for b in bodies if b)
    return opening > closing


def _spans(text: str, pattern: re.Pattern, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The parts of text[lo:hi] between matches, trimmed, without empty ones."""
    part = text[lo:hi]
    edges = [0, *[x for m in pattern.finditer(part) for x in m.span()], len(part)]
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        inner = part[a:z]
        if inner.strip():
            yield lo + a + len(inner) - len(inner.lstrip()), lo + a + len(inner.rstrip())


def sentences(text: str) -> list[Sentence]:
    """The sentences of an answer, each with its citation markers.

    A marker that stands loose at a sentence's front belongs to the sentence before it in the block, unless the answer leads
    with its markers or there is none before; if nothing is left to carry it, it's an orphan.
    """
    front = leads(text)
    edges = [0, *[x for m in _BLOCK_END.finditer(text) for x in m.span()], len(text)]
    out: list[Sentence] = []
    for block, (lo, hi) in enumerate(zip(edges[::2], edges[1::2], strict=True)):
        for a, z in _spans(text, _SENTENCE_END, lo, hi):
            loose = _OPENING_MARKERS.match(text[a:z])
            if not loose:
                out.append(Sentence(text[a:z], block, a, z))
                continue
            rest = a + loose.end()
            markers_end = a + len(loose.group().rstrip())
            before = out[-1] if out and out[-1].block == block and not out[-1].orphan else None
            if rest < z and (front or before is None):
                out.append(Sentence(text[a:z], block, a, z))
                continue
            if before is not None:
                out[-1] = replace(before, text=text[before.start : markers_end], end=markers_end)
            else:
                out.append(Sentence(text[a:markers_end], block, a, markers_end, orphan=True))
            if rest < z:
                out.append(Sentence(text[rest:z], block, rest, z))
    return out


def numbers(text: str) -> list[int]:
    return [int(x) for m in _CITATION.finditer(text) for x in m.group(1).split(",")]


def validate(answer: str, sources: dict[int, set[str]]) -> dict:
    """An answer's citations, checked: invalid ones taken out, sentences about the evidence's gaps freed of theirs, and every
    other cited sentence scored by its best cited source."""
    invalid: list[int] = []

    def keep(m: re.Match) -> str:
        wanted = [int(x) for x in m.group(1).split(",")]
        invalid.extend(n for n in wanted if n not in sources)
        kept = [str(n) for n in wanted if n in sources]
        return f"[{', '.join(kept)}]" if kept else ""

    text = _CITATION.sub(keep, answer)
    freed: list[Sentence] = []
    orphans = unscoreable = cited = supported = 0
    support: list[float] = []
    for s in sentences(text):
        refs = numbers(s.text)
        if not refs:
            continue
        if s.orphan:
            orphans += 1
        elif about_evidence(s.text):
            freed.append(s)
        elif not (claim := content_words(re.sub(r"\[[\d,\s]+\]", "", s.text))):
            unscoreable += 1
        else:
            best = max(len(claim & sources[n]) / len(claim) for n in refs)
            cited, supported = cited + 1, supported + (best >= SUPPORTED)
            support.append(best)
    for s in reversed(freed):
        text = text[: s.start] + re.sub(r"\s*\[\d+(?:\s*,\s*\d+)*\]", "", s.text) + text[s.end :]
    used = sorted(set(numbers(text)))
    return {
        "answer": re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip(),
        "cited": used,
        "uncited": sorted(set(sources) - set(used)),
        "invalid": invalid,
        "cited_sentences": cited,
        "supported_sentences": supported,
        "orphans": orphans,
        "freed": len(freed),
        "unscoreable": unscoreable,
        "groundedness": int(supported / cited * 1000 + 0.5) / 1000 if cited else None,
        "support": support,
    }


SCHEMA = (
    "answer string, cited array<int>, uncited array<int>, invalid array<int>, cited_sentences int, supported_sentences int, orphans int, freed int,"
    " unscoreable int, groundedness double, support array<double>"
)


def validated(answers: DataFrame, key: str, text: str, sources: DataFrame, number: str, source_text: str) -> DataFrame:
    """(key, SCHEMA): every answer checked against the sources with its key; one without sources has only invalid citations.

    Sources' terms are found by the JVM; an answer has a few, so they travel with it. Rewriting an answer needs its sentences
    in order, so this step runs in Python by Arrow batches. Null answers are left out.
    """
    kind = answers.schema[key].dataType.simpleString()
    known = sources.where(F.col(source_text).isNotNull()).groupBy(key).agg(F.collect_list(F.struct(F.col(number).alias("n"), F.expr(T.content_words(source_text)).alias("terms"))).alias("sources"))
    both = answers.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")).join(known, key, "left").select(F.col(key).alias("k"), "text", "sources")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, answer, own in zip(batch["k"], batch["text"], batch["sources"], strict=True):
                by_number = {s["n"]: set(s["terms"]) for s in own} if own is not None else {}
                rows.append({"k": k} | validate(answer, by_number))
            yield pd.DataFrame(rows, columns=["k", *[c.split()[0] for c in SCHEMA.split(", ")]])

    return both.mapInPandas(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)


def claim_words(claim: str) -> str:
    """SQL: a claim's content words, without its citation markers."""
    return T.content_words(f"regexp_replace({claim}, {q('[' + chr(92) + '[][0-9, ]+[' + chr(92) + ']]')}, '')")


def support(claim: str, source: str) -> str:
    """SQL: the share of a claim's content words that a source has; null without any."""
    c, s = claim_words(claim), T.content_words(source)
    return f"case when size({c}) > 0 then size(array_intersect({c}, {s})) / size({c}) end"


def spaced(text: str) -> str:
    """SQL: a text in lower case with single spaces, as snippets are sought in pages."""
    return f"trim(regexp_replace(lower({text}), {q(L.SPACE + '+')}, ' '))"


def window_found(tokens: str, hay: str, n: str) -> str:
    return f"size({tokens}) >= {n} and exists(sequence(0, size({tokens}) - {n}), i -> contains({hay}, array_join(slice({tokens}, i + 1, {n}), ' ')))"


def grounded(tokens: str, hay: str, window: int = 12) -> str:
    """Whether any window of a snippet's tokens, or the whole of a shorter one, stands in the text."""
    return f"case when size({tokens}) = 0 then false when size({tokens}) <= {window} then contains({hay}, array_join({tokens}, ' ')) else {window_found(tokens, hay, str(window))} end"


def longest_window(tokens: str, hay: str, most: int = 12) -> str:
    """The longest window of a snippet's tokens, up to most and from 2, that stands in the text; else 0.

    With a window all shorter ones are found, so the length is halved in on: four searches, not one for every length.
    """
    sizes = [0, *range(2, most + 1)]

    def between(lo: int, hi: int) -> str:
        if lo == hi:
            return str(sizes[lo])
        middle = (lo + hi + 1) // 2
        return f"case when {window_found(tokens, hay, str(sizes[middle]))} then {between(middle, hi)} else {between(lo, middle - 1)} end"

    return between(0, len(sizes) - 1)


def provenance(kind: str, grounded_: str, position: str, chars: str, window: str, n_tokens: str, snippet: str) -> str:
    """Why a citation can't be traced to its source, or that it can."""
    return (
        f"case when {kind} = 'doc' then case when {grounded_} then 'verified' when {position} > 5 then 'beyond_top_five' else 'locator_missed' end"
        f" when coalesce({chars}, 0) = 0 then 'fetch_blocked' when {grounded_} or {window} >= 12 then 'verified' when {n_tokens} < 12 then 'snippet_short'"
        f" when {window} >= 6 then case when {snippet} rlike '(?i)&[a-z#0-9]+;' then 'entity' else 'token_boundary' end"
        f" when {chars} < 2000 then 'dynamic_page' else 'page_changed' end"
    )


def outcome(prefix: str = "") -> str:
    """Where a retrieval went wrong, from its counts and judgements; an undecided judgement leaves it pending."""
    return (
        "case when not reviewed then 'pending_review' when relevant = 0 then 'query_miss'"
        " when attempted = 0 then case when best_rank > deepest_rank then 'ranking_miss' else 'selection_miss' end"
        " when usable = 0 then 'fetch_failure' when contains_answer is null then 'pending_review'"
        " when not contains_answer then case when cancelled > 0 and stopped_on_coverage then case when faithful is null then 'pending_review' when faithful then 'coverage_miss' else 'passage_miss' end else 'passage_miss' end"
        " when addressed is null or complete is null then 'pending_review' when not addressed or not complete then 'synthesis_omission'"
        " when cited = 0 or supported < cited then 'citation_failure' else 'successful_retrieval' end"
    )
