"""Articles from HTML pages, by the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an article keeps unless a caller says otherwise.
MOST_CHARACTERS = 24_000
LEAST_LINE = 40

# Elements that hold no article text, elements without content, and where articles stand.
_SKIPPED = frozenset("script style noscript svg iframe form nav header footer aside".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PLACES = {"id": {"content"}, "class": {"post-content", "article-body"}}
SCHEMA = "title string, published_at string, author string, description string, text string"


class _Page(HTMLParser):
    """Collects texts by candidate element, with how much of each stands in links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title, self.h1, self.time = "", "", ""
        self.path: list[tuple[str, bool, int | None]] = []  # tag, skipped, candidate
        self.candidates: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta[(a.get("property") or a.get("name") or "").lower()] = a.get("content", "")
        if tag == "time":
            self.time = self.time or a.get("datetime", "")
        self._gap()
        if tag in _VOID:
            if tag in ("br", "hr"):
                self._break()
            return
        candidate = None
        if tag in ("article", "main", "body") or a.get("role") == "main" or a.get("id") in _PLACES["id"] or _PLACES["class"] & set(a.get("class", "").split()):
            candidate = len(self.candidates)
            self.candidates.append({"lines": [""], "link": 0, "all": 0})
        self.path.append((tag, tag in _SKIPPED or a.get("aria-hidden") == "true", candidate))
        self._break(tag)

    def handle_endtag(self, tag: str) -> None:
        self._gap()
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                self._break(tag)
                del self.path[i:]
                return

    def handle_data(self, data: str) -> None:
        tags = [t for t, _, _ in self.path]
        if tags and tags[-1] == "title":
            self.title += data
        if any(skipped for _, skipped, _ in self.path):
            return
        if "h1" in tags:
            self.h1 += data
        for _, _, c in self.path:
            if c is not None:
                held = self.candidates[c]
                held["lines"][-1] += data.replace("\n", " ")
                held["all"] += len(data.strip())
                held["link"] += len(data.strip()) if "a" in tags else 0

    def _gap(self) -> None:
        for _, _, c in self.path:
            if c is not None:
                self.candidates[c]["lines"][-1] += " "

    def _break(self, tag: str = "br") -> None:
        if tag in ("a", "b", "i", "em", "strong", "span", "code", "sup", "sub", "u", "small"):
            return
        for _, _, c in self.path:
            if c is not None:
                self.candidates[c]["lines"].append("")


def article(html: str, url: str = "", most: int | None = MOST_CHARACTERS) -> dict:
    """Title, dates and the paragraphs of the densest candidate: long, and little of it in links. most: characters of the
    text, or None for all."""
    page = _Page()
    page.feed(html or "")
    page.close()

    def worth(c: dict) -> float:
        return c["all"] * max(0.15, 1 - c["link"] / c["all"]) if c["all"] else 0.0

    best = max(page.candidates, key=worth, default={"lines": []})
    lines = [re.sub(r"\s+", " ", x).strip() for x in best["lines"]]
    host = re.sub(r"^[a-z]+://([^/]*).*$", r"\1", url)
    meta = page.meta
    return {
        "title": (meta.get("og:title") or page.title or page.h1 or host).strip(),
        "published_at": meta.get("article:published_time") or meta.get("date") or page.time or None,
        "author": meta.get("author") or meta.get("article:author") or None,
        "description": meta.get("description") or meta.get("og:description") or None,
        "text": "\n\n".join(x for x in lines if len(x) > LEAST_LINE)[:most],
    }


def articles(pages: DataFrame, key: str, html: str, url: str, most: int | None = MOST_CHARACTERS) -> DataFrame:
    """(key, SCHEMA) of every page with HTML, the text of at most so many characters, or all of it with None; parsing runs in Python by Arrow batches, without a shuffle."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"k": k} | article(h, u or "", most) for k, h, u in zip(batch["k"], batch["h"], batch["u"], strict=True)]
            yield pd.DataFrame(rows, columns=["k", *[c.split()[0] for c in SCHEMA.split(", ")]])

    picked = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("k"), F.col(html).alias("h"), F.col(url).alias("u"))
    return picked.mapInPandas(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)
