"""Text functions as columns. Each takes and gives SQL text, so that plans stay within whole-stage code and Catalyst sees them."""

from __future__ import annotations

from groundwork.functions import literals as L
from groundwork.functions.literals import spark_text as q


def tokens(text: str) -> str:
    """Lower-case tokens of letters, digits and inner symbols, 2 to 39 characters long; of null, null."""
    return f"filter(regexp_extract_all(lower({text}), {q(L.TOKEN)}, 0), x -> length(x) between 2 and 39)"


def content_words(text: str, stop: str = L.STOP_EVIDENCE, least: int = 2) -> str:
    """The distinct tokens that are no stop words, in order of first use."""
    kept = f"array_except({tokens(text)}, {L.spark_words(stop)})"
    return kept if least <= 2 else f"filter({kept}, x -> length(x) >= {least})"


def coverage(passage: str, question: str) -> str:
    """The share of the question's content words that the passage has; 0 for a question without any."""
    return coverage_of(tokens(passage), tokens(question))


def coverage_of(passage_tokens: str, question_tokens: str) -> str:
    """coverage, from columns of tokens, which a plan with several features makes once."""
    asked = f"array_except({question_tokens}, {L.spark_words(L.STOP_ORDER)})"
    return f"transform(array({asked}), q -> case when size(q) = 0 then 0D else size(array_intersect(q, {passage_tokens})) / size(q) end)[0]"


def prosiness(passage: str) -> str:
    """How much a passage reads like sentences: function words, and ends of sentences per hundred words."""
    return prosiness_of(passage, tokens(passage))


def prosiness_of(passage: str, t: str) -> str:
    stop = L.spark_words(L.STOP_ORDER)
    ends = f"regexp_count({passage}, {q('[.!?](?:' + L.SPACE + '|$)')})"
    return (
        f"case when size({t}) < 4 then 0.5D else 0.7D * least(1D, size(filter({t}, x -> array_contains({stop}, x))) / size({t}) / 0.3D)"
        f" + 0.3D * least(1D, {ends} / greatest(1D, size({t}) / 100D) / 4D) end"
    )


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, {q('^' + L.SPACE + '+|' + L.SPACE + '+$')}, '')"


def fragment_ratio(passage: str) -> str:
    """The share of lines that are short and don't end a sentence."""
    lines = f"filter(transform(split({passage}, '\\n+'), x -> {trimmed('x')}), x -> length(x) > 1)"
    short = f"filter(ls, x -> length(x) < 90 and not x rlike {q('[.!?][' + chr(34) + chr(39) + ')' + chr(92) + ']]*$')})"
    return f"transform(array({lines}), ls -> case when size(ls) = 0 then 0D else size({short}) / size(ls) end)[0]"


def structured(passage: str) -> str:
    """Digits or operators enough for a table or a formula."""
    operators = "[=<>×*/+%]|\\bbytes\\b|\\bms\\b|\\bGB\\b|\\bKB\\b"
    return f"(regexp_count({passage}, '[0-9]') / greatest(1, length({passage})) > 0.02D or regexp_count({passage}, {q(operators)}) >= 2)"


def cache_key(query: str) -> str:
    """A question's words in one order and form, so that equal questions have equal keys."""
    plain = f"regexp_replace(regexp_replace(lower({query}), {q('[' + chr(39) + '’]s' + chr(92) + 'b')}, ''), {q('[^a-z0-9' + L.SPACE[1:-1] + ']+')}, ' ')"
    words = f"filter(split({plain}, {q(L.SPACE + '+')}), w -> w != '' and not array_contains({L.spark_words(L.STOP_CACHE)}, w))"
    stems = f"transform({words}, w -> case when length(w) > 3 and w like '%s' and w not like '%ss' then left(w, length(w) - 1) else w end)"
    return f"array_join(array_sort(array_distinct({stems})), ' ')"


def plan_fingerprint(question: str) -> str:
    """A question's content words, sorted, repeated ones as well."""
    plain = f"regexp_replace(lower({question}), {q('[^a-z0-9' + L.SPACE[1:-1] + ']')}, ' ')"
    words = f"filter(split({plain}, {q(L.SPACE + '+')}), w -> length(w) > 2 and not array_contains({L.spark_words(L.STOP_PLAN)}, w))"
    return f"array_join(array_sort({words}), ' ')"


def search_query(question: str) -> str:
    plain = f"regexp_replace(regexp_replace({question}, {q(L.POLITE)}, ''), {q(L.SPACE + '+')}, ' ')"
    return f"left({trimmed(plain)}, 300)"


def broadened(question: str) -> str:
    """The first twelve words of a search query without its marks."""
    return f"array_join(slice(split(regexp_replace({search_query(question)}, '[?!.]', ''), {q(L.SPACE + '+')}), 1, 12), ' ')"


def absence_claim(sentence: str) -> str:
    """Whether a sentence speaks of what the evidence lacks rather than of the subject."""
    plain = f"regexp_replace(regexp_replace({sentence}, {q('[' + chr(92) + '[][0-9,' + L.SPACE[1:-1] + ']+[' + chr(92) + ']]')}, ' '), {q(L.SPACE + '+')}, ' ')"
    return "(" + " or ".join(f"{plain} rlike {q(p)}" for p in L.ABSENCE) + ")"


def refusal(sentence: str) -> str:
    return f"({absence_claim(sentence)} or " + " or ".join(f"{sentence} rlike {q(p)}" for p in L.REFUSAL) + ")"


def shape(sentence: str) -> str:
    """The structural shape of a sentence; the first that matches."""
    s = f"coalesce({sentence}, '')"
    tests = {name: f"{s if name in ('list_item', 'formula_or_spec', 'quotation_fragment') else trimmed(s)} rlike {q(p)}" for name, p in L.SHAPES.items()}
    tests["evidence_gap_disclosure"] = f"({absence_claim(s)} or {s} rlike {q(L.SHAPES['evidence_gap_disclosure'])})"
    tests["quotation_fragment"] += f" and not {trimmed(s)} rlike {q('^[' + chr(34) + '“]')}"
    return "case " + " ".join(f"when {t} then '{n}'" for n, t in tests.items()) + " else 'continuation_prose' end"


def names_subject(question: str) -> str:
    """Whether a question names what it's about: a capitalised word that isn't only the first, a digit, a joined or a quoted term."""
    first = f"split({trimmed(question)}, {q(L.SPACE + '+')})[0]"
    rest = f"regexp_replace({trimmed(question)}, {q('^[^' + L.SPACE[1:-1] + ']*')}, '')"
    return (
        f"(({first} rlike '^[A-Z][a-zA-Z]{{2,}}' and not {first} rlike {q(L.OPENER_WORD)}) or {rest} rlike '[A-Z][a-zA-Z]{{2,}}' or {question} rlike '[0-9]'"
        f" or {question} rlike '(?i)[a-z]+[-.][a-z]+' or {question} rlike {q('[' + chr(34) + chr(39) + '][^' + chr(34) + chr(39) + ']{4,}[' + chr(34) + chr(39) + ']')})"
    )


def question_kind(question: str, mode: str, space: str, has_documents: str, turns: str) -> str:
    """The route of a question: explicit choices first, then what leans on the conversation, then what stands on its own."""
    t = f"coalesce({trimmed(question)}, '')"
    named = names_subject(t)
    words = f"size(filter(split({t}, {q(L.SPACE + '+')}), w -> w != ''))"
    memory = " or ".join(f"{t} rlike {q(p)}" for p in L.MEMORY_INSTRUCTION)
    follows = f"{t} rlike {q(L.BACK_REFERENCE)} or (({words} <= 4 or {t} rlike {q(L.REFERENTIAL_OPENER)} or {t} rlike {q(L.DANGLING_REFERENCE)}) and not {named})"
    return (
        f"case when {memory} then 'memory_instruction'"
        f" when {mode} = 'docs' or ({space} is not null and {mode} != 'web') or ({mode} = 'auto' and {has_documents} and {space} is not null) then 'documents'"
        f" when {turns} > 0 and ({follows}) then 'contextual_follow_up' else 'standalone_web' end"
    )


def memory_content(text: str) -> str:
    """What an instruction to remember asks to keep; null if that is nothing or a fragment."""
    t = trimmed(text)
    colon = f"regexp_replace({t}, '^[^:]{{0,80}}:[ \\n\\r\\t]*', '')"
    bare = f"regexp_replace({t}, {q(L.IMPERATIVE)}, '')"
    imperative = f"{t} rlike {q(L.IMPERATIVE)} and not {t} rlike {q(L.MEMORY_INSTRUCTION[3])}"
    content = f"case when {imperative} then case when {colon} != {t} and {trimmed(colon)} != '' then {colon} else {bare} end else {t} end"
    tidy = f"regexp_replace({trimmed(f'regexp_replace({content}, {q(L.SPACE + chr(43))}, {q(chr(32))})')}, '^[,:;-][ ]*', '')"
    return f"case when length({tidy}) < 3 or (length({tidy}) < 12 and not {tidy} like '% %') then null else {tidy} end"


def usable_rewrite(text: str) -> str:
    """The first line of a rewritten question without quotes around; null if it's empty, long or chatty."""
    line = trimmed(f"split(regexp_replace({trimmed(text)}, {q('^[' + chr(34) + chr(39) + '`]|[' + chr(34) + chr(39) + '`]$')}, ''), '\\n')[0]")
    return f"case when {line} = '' or length({line}) > 300 or {line} rlike {q(L.CHATTY)} then null else {line} end"


def citation_numbers(text: str) -> str:
    """Sorted distinct numbers of single-number citation markers."""
    return f"array_sort(array_distinct(transform(regexp_extract_all({text}, {q(L.SINGLE_CITATION)}, 1), x -> cast(x as int))))"


def plain_tokens(text: str) -> str:
    """Words of a-z, digits and apostrophes, for matching passages."""
    plain = f"regexp_replace(lower(replace({text}, '’', '''')), {q('[^a-z0-9' + chr(39) + ']+')}, ' ')".replace("''''", q("'"))
    return f"filter(split({plain}, ' '), x -> x != '')"


def without_markup(html: str) -> str:
    """HTML without scripts, styles, tags and entities."""
    t = f"regexp_replace(regexp_replace({html}, '(?is)<script[^>]*>.*?</script>', ' '), '(?is)<style[^>]*>.*?</style>', ' ')"
    return f"regexp_replace(regexp_replace({t}, '(?s)<[^>]+>', ' '), '(?i)&[a-z#0-9]+;', ' ')"


def pages(text: str, size: int = 3000) -> str:
    """array<struct<page, label, text>>: slices of a flat text, one page even if it's empty."""
    flat = f"regexp_replace(regexp_replace(replace(coalesce({text}, ''), '\\r\\n', '\\n'), '[ \\t]+', ' '), '\\n{{3,}}', '\\n\\n')"
    return (
        f"transform(array({trimmed(flat)}), t -> transform(sequence(0, greatest(0, cast(ceil(length(t) / {size}D) as int) - 1)), i -> "
        f"named_struct('page', i + 1, 'label', concat('section ', i + 1), 'text', substr(t, i * {size} + 1, {size}))))[0]"
    )
