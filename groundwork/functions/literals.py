"""Patterns and word lists as SQL literals, and the fixed values that several functions share."""

from __future__ import annotations


def spark_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ansi_text(value: str) -> str:
    """A string literal of ANSI SQL."""
    return "'" + value.replace("'", "''") + "'"


def spark_words(value: str) -> str:
    return "array(" + ", ".join(spark_text(w) for w in value.split()) + ")"


def ansi_words(value: str) -> str:
    return "[" + ", ".join(ansi_text(w) for w in value.split()) + "]"


# Word lists whose members decide results.
STOP_EVIDENCE = (
    "the a an and or but if then than that this these those of in on at to for with from by as is are was were be been being it its it's they them their "
    "there here what which who whom how why when where can could should would may might will shall do does did not no yes we you i he she his her our your "
    "my me us also more most some any each other into over under about after before between during such only very"
)
STOP_ORDER = STOP_EVIDENCE.replace(" it's", "")
STOP_COVERAGE = (
    "the a an and or of in on at to for with from by as is are was were be been being it its this that these those what which who whom how why when where "
    "can could should would may might will shall do does did not no yes i you he she they we us our your their my me him her them there here about into over "
    "under after before between during such only very more most some any each other than then also new latest current"
)
STOP_CACHE = "a an the of in on at to for with from by as is are was were be do does did what which who whom how why when where can could should would will"
STOP_PLAN = "the a an and or of in on at to for with from by as is are was were be been what which how why when does do did"

# Patterns.
TOKEN = r"[a-z0-9][a-z0-9'+.#-]*"
SPACE = "[\\s\u00a0\ufeff\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TRACKING = r"^(utm_|fbclid|gclid|mc_cid|mc_eid|ref_?src)"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
SINGLE_CITATION = r"\[(\d{1,3})\]"
ABSENCE = [
    r"(?i)\b(?:no|none|neither)\s+(?:of\s+(?:the|these|those)\s+)?(?:sources?|pages?|results?|documents?|excerpts?)\b",
    r"(?i)\bnothing\s+(?:in|among|from|within)\s+(?:the\s+)?(?:sources?|results?|pages?|documents?|evidence|material)\b",
    r"(?i)\b(?:the\s+)?(?:sources?|search\s+results?|results?\s+returned|pages?(?:\s+(?:I|we)\s+(?:read|fetched|retrieved))?"
    r"|documents?\s+(?:I|we)\s+(?:read|retrieved)|evidence(?:\s+(?:I|we)\s+(?:found|gathered|read|retrieved))?"
    r"|material\s+(?:I|we)\s+(?:read|found)|available\s+(?:evidence|sources?|material|information|record))\s+"
    r"(?:\w+\s+){0,3}?(?:do(?:es)?\s+not|did\s+not|don't|doesn't|didn't|are\s+silent|is\s+silent|contains?\s+no"
    r"|includes?\s+no|provides?\s+no|offers?\s+no|lacks?|fails?\s+to|failed\s+to|cannot|can't|could\s+not)\b",
    r"(?i)\b(?:I|we)\s+(?:was|were)?\s*(?:unable\s+to|could\s+not|couldn't|did\s+not|didn't)\s+(?:find|locate|retrieve|access|confirm)\b",
]
REFUSAL = [
    r"(?i)\bI (?:cannot|can't|could not|couldn't|don't have (?:sufficient|enough))\b[^.]{0,60}\b(?:answer|evidence|detail|information)\b",
    r"(?i)\bI would need\b",
    r"(?i)\b(?:the )?evidence (?:provided|given|available)?\s*(?:is|does not|doesn't|only)\b",
    r"(?i)\b(?:does|do) not (?:contain|address|cover|explain|discuss|provide)\b",
]
MEMORY_INSTRUCTION = [
    r"(?i)^\s*(?:please\s+)?(?:remember|memorise|memorize|note|keep in mind|make a note)\b(?:\s+(?:that|this|i|my|we|our)\b|\s*[:,])",
    r"(?i)^\s*(?:please\s+)?(?:forget|delete|remove|erase)\b.{0,40}\b(?:that|this|memory|memories|what i (?:said|told))\b",
    r"(?i)^\s*(?:don'?t|do not) forget\b",
    r"(?i)^\s*(?:from now on|going forward|in future|always|never)\b",
]
BACK_REFERENCE = r"(?i)\b(?:you (?:said|mentioned|wrote)|as (?:above|mentioned)|earlier|previously|before that|the last one|that answer)\b"
REFERENTIAL_OPENER = r"(?i)^\s*(?:and|but|so|also|then|what about|how about|why|why not|what if|which one|who|when|where|ok(?:ay)?[,\s]|yes[,\s]|no[,\s])\b"
DANGLING_REFERENCE = r"(?i)\b(?:it|its|it's|they|them|their|that|those|these|this|he|him|his|she|her|the former|the latter|the same|the above|the one)\b"
OPENER_WORD = (
    r"(?i)^(?:what|why|how|when|where|who|which|is|are|was|were|do|does|did|can|could|should|would|will|and|but|so|also|then|ok|okay|yes|no|the|a|an|tell"
    r"|give|explain|compare|list|show|any|more|about)$"
)
IMPERATIVE = r"(?i)^\s*(?:please\s+)?(?:remember|memorise|memorize|note|keep in mind|make a note)\b(?:\s+(?:that|this)\b)?[\s:,-]*"
POLITE = r"(?i)^\s*(?:can you|could you|please|i want to know|tell me|do you know)\b[,\s]*"
CHATTY = r"(?i)^(?:sure|certainly|here(?:'s| is)|the standalone|rewritten)\b"
TIME_SENSITIVE = (
    r"(?i)\b(?:today|now|current|currently|latest|newest|recent|recently|this (?:week|month|year)|as of|so far|right now|still|202\d|up to date|nowadays)\b"
)
AGGREGATOR = r"(?i)(?:^|\.)(?:wikipedia\.org|reddit\.com|quora\.com|medium\.com|pinterest\.[a-z.]+|facebook\.com|x\.com|twitter\.com|tumblr\.com|substack\.com)$"
SHAPES = {
    "list_item": r"^\s*(?:[-*+•]|\d+[.)])\s+\S",
    "formula_or_spec": r"(?:^|\s)(?:[A-Za-z_]\w*\s*=\s*\S|\d+\s*[*x×]\s*[A-Za-z]|[<>]=?\s*\d|≤|≥)",
    "list_introduction": r":\s*$",
    "quotation_fragment": r"^[^\"“]+[\"”]\s",
    "evidence_gap_disclosure": r"(?i)\b(?:the evidence|the article|the document|the source)\b[^.]*\b(?:does not|do not|but it does not|mentions? that)\b|(?i)\bI would need\b",
    "framing_sentence": r"(?i)^(?:The (?:practical |key |main |primary )?(?:difference|point|result|decision|design|distinction)\b[^.]{0,60}(?:follows|emerges|is not|matters)"
    r"|Key \w+ (?:differences|points) follow|This (?:design|approach) works well)\b",
}
