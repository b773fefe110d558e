"""Texts the way a reader sees them: without markup, citation markers and the traces of layout and encoding."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import regex

_BLOCK = "address|article|aside|blockquote|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|img|input|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
_COMMENT = regex.compile(r"<!--.*?-->|<(script|style)\b[^<>]*>.*?</\1\s*>", regex.S | regex.I)
_BLOCK_TAG = regex.compile(rf"</?(?:{_BLOCK})\b[^<>]*>", regex.I)
_TAG = regex.compile(r"</?[A-Za-z][^<>]*>")
_CITATION = regex.compile(r"\[\s*\^?\d{1,4}(?:\s*[,;–-]\s*\^?\d{1,4})*\s*\]|[¹²³⁰⁴-⁹⁺⁻]+")
_LINK = regex.compile(r"\[([^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"\n]*\")?\)")
_EMPHASIS = regex.compile(r"[*`~]+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}]+")
_DIVIDED = regex.compile(r"(?<=[\p{L}\p{N}])[-‐]\p{Cf}*[ \t]*(?:\r\n?|\n)[ \t>|*•]*(?=[\p{L}\p{N}])")
_SOFT = regex.compile(r"\xad[ \t]*(?:\r\n?|\n)[ \t]*")
_SYMBOL = regex.compile(r"[\p{So}\p{Sc}\p{Sk}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")


def visible(text: str) -> str:
    """The text without markup, links' targets, emphasis and citation markers; line ends stay."""
    t = text
    if "<" in t:
        t = _TAG.sub("", _BLOCK_TAG.sub(" ", _COMMENT.sub(" ", t)))
    if "&" in t:
        t = html.unescape(t)
    if "](" in t:
        t = _LINK.sub(r"\1", t)
    return _SOFT.sub("", _EMPHASIS.sub("", _CITATION.sub(" ", t)))


def undivided(text: str) -> str:
    """The text with the words joined that a hyphen divides at a line's end."""
    return _DIVIDED.sub("", text)


def composed(text: str) -> str:
    """Without invisible characters, with one encoding for equal characters."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", _SYMBOL.sub(" ", _INVISIBLE.sub("", text)))


def words(text: str) -> list[str]:
    """The runs of letters and digits of a visible text, case folded."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", composed(text).casefold()))


def _mixed(seen: str, reach: int) -> Iterator[list[str]]:
    """The words around hyphens at line ends that stand within reach words of each other, with some of them joined and others
    not, in every way that isn't the same for all."""
    pieces, at = [], 0
    for m in _DIVIDED.finditer(seen):
        pieces.append(seen[at : m.start()])
        at = m.end()
    if len(pieces) < 2:
        return
    parts = [words(p) for p in [*pieces, seen[at:]]]
    last = 0
    for i in range(len(pieces)):
        # hyphen i stands between the parts i and i + 1
        j, between = i, 0
        while j + 1 < len(pieces) and between + len(parts[j + 1]) <= reach + j + 1 - i:
            between += len(parts[j + 1])
            j += 1
        if j <= max(i, last):
            continue
        last = j
        for joined in itertools.product((False, True), repeat=j - i + 1):
            if len(set(joined)) > 1:
                out = parts[i][-reach:]
                for k, join in enumerate(joined, i + 1):
                    more = parts[k][:reach] if k == j + 1 else parts[k]
                    if join and out and more:
                        out = [*out[:-1], out[-1] + more[0], *more[1:]]
                    else:
                        out = [*out, *more]
                yield out


def readings(text: str, reach: int = 12) -> list[list[str]]:
    """The words of a text as a reader sees them: runs of letters and digits, whatever case, punctuation, layout, markup,
    citation markers or encoding of characters. A hyphen at a line's end may divide a word or belong to it; a text with any
    is read in both ways, and where several stand within reach words, those parts are read in all ways."""
    seen = visible(text)
    joined = undivided(seen)
    return [words(joined)] + ([words(seen), *_mixed(seen, reach)] if joined != seen else [])
