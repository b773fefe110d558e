"""Pages as overlapping chunks that never leave their page and know where on it they stand."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST = 1200, 180, 60
SCHEMA = "chunk_index int, page int, page_label string, char_start int, char_end int, line int, text string"


def cuts(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text: at most size long, ended by a paragraph, else a sentence, in their second half,
    else hard; the next starts overlap before."""
    if len(text) <= size:
        return [(0, len(text))]
    pieces, start = [], 0
    while True:
        end = min(len(text), start + size)
        if end < len(text):
            paragraph = text.rfind("\n\n", start, end) - start
            sentence = max(text.rfind(mark, start, end) for mark in (". ", "? ", "! ")) - start
            if paragraph > size * 0.5:
                end = start + paragraph
            elif sentence > size * 0.5:
                end = start + sentence + 1
        pieces.append((start, end))
        if end >= len(text):
            return pieces
        start = max(end - overlap, start + 1)


def passages(text: str, most: int = 1400, least: int = 80) -> list[str]:
    """Paragraphs gathered up to about most characters; gatherings of least or fewer are left out."""
    import re

    out, held = [], ""
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n{2,}", text or ""))):
        if held and len(held) + len(paragraph) > most:
            out.append(held)
            held = ""
        held = f"{held}\n\n{paragraph}" if held else paragraph
    return [p for p in [*out, held] if len(p.strip()) > least]


def page_chunks(pages: list[tuple[int, str | None, str | None]], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple]:
    """Rows of SCHEMA for a document's pages (page, label, text); pieces of fewer than LEAST characters are left out."""
    import re

    rows: list[tuple] = []
    for page, label, raw in pages:
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", raw or "")).strip()
        for start, end in cuts(text, size, overlap) if text else []:
            piece = text[start:end]
            if len(piece.strip()) < LEAST:
                continue
            first = start + len(piece) - len(piece.lstrip())
            rows.append((len(rows), page, label or f"p. {page}", start, end, 1 + text.count("\n", 0, first), piece.strip()))
    return rows


def chunked(df: DataFrame, key: str, text: str, page: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, SCHEMA) of every document: its own page number, else pages of 3000 characters.

    Splitting is sequential within a text, so this runs in Python by Arrow batches; documents are independent, and nothing is
    shuffled. Null, empty and short texts have no chunk.
    """
    from groundwork.functions.text import pages as paginate
    from groundwork.runtime import bounded_batches

    bounded_batches(df.sparkSession)

    kind = df.schema[key].dataType.simpleString()
    pages = f"array(named_struct('page', {page}, 'label', cast(null as string), 'text', {text}))" if page else paginate(text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, own in zip(batch["k"], batch["pages"], strict=True) for row in page_chunks([(p["page"], p["label"], p["text"]) for p in own], size, overlap)]
            yield pd.DataFrame(rows, columns=["k", *[c.split()[0] for c in SCHEMA.split(", ")]])

    base = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.expr(pages).alias("pages"))
    out = base.mapInPandas(run, f"k {kind}, {SCHEMA}")
    return out.withColumnRenamed("k", key)
