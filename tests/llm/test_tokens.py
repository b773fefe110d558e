"""Ids by fragments are the ids of the whole text."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm.queries import vocabulary
from groundwork.llm.tokens import PATTERN, Encoder, encode_corpus, read_ranks

PATH = vocabulary("byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
ENCODER = Encoder(read_ranks(PATH), PATTERN) if os.path.exists(PATH) else None

PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\r\n", "\t", " ", "　", " ", "'s", "'", "!'s", "don't", "'ll", "x", "Q", "qZ", "é", "ß", "日本", "🙂", "123", "4a", "...", "!?", "<|endoftext|>", "\x1c", "'re", "''", "ab'c"]), max_size=25)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=60), PIECES.map("".join)))
def test_fragments_equal_the_whole(text):
    assert ENCODER.encode(text) == ENCODER.bpe.encode_ordinary(text)


def test_most_fragments_are_words():
    assert ENCODER.cut[ord("a"), ord(" ")] and not ENCODER.cut[ord(" "), ord("a")]


def test_corpus(spark):
    long = "word and 数字 " * 30_000 + "a" * 50_000
    rows = [(1, "Hello world", [9]), (2, "", [9]), (3, None, [9]), (4, "<|endoftext|>", [9]), (5, long, [9]), (5, "twice", [9]), (None, "no key", [9])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = {}
    for r in encode_corpus(df, "doc_id", "text", PATH).collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert got[2] == [[]] and got[3] == [[]] and len(got[5]) == 2 and len(got) == 6
    for key, text in ((1, "Hello world"), (4, "<|endoftext|>"), (None, "no key")):
        assert got[key] == [ENCODER.bpe.encode_ordinary(text)]
    assert ENCODER.bpe.encode_ordinary(long) in got[5] and ENCODER.bpe.decode(max(got[5], key=len)) == long
    assert encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0
