"""The queries with SQL give what DuckDB gives; the others give what brute force or the hand labels say."""

import pytest
from oracle import check, connect

from groundwork.llm.queries import QUERIES, SQL, vocabulary
from groundwork.llm.text import readings
from groundwork.llm.tokens import PATTERN, Encoder, read_ranks


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, data, name):
    check(spark, con, QUERIES[name], SQL[name], data)


def test_every_query_without_sql_has_a_test():
    assert set(QUERIES) - set(SQL) == {"p6_ids", "p7_found", "p8_found", "p8_shares", "p8_mixture", "p2_near"}


def test_p2_near_keeps_every_call(spark, con, data):
    want = dict(con.sql("select record_id, len(tools) from (select distinct on (record_id) * from quick_path) where len(tools) > 0").fetchall())
    rows = QUERIES["p2_near"](spark, data).toPandas()
    assert rows.groupby("record_id")["calls"].sum().to_dict() == want
    assert (rows["calls"] > 1).any()


def test_p6_ids_are_those_of_the_public_tokenizer(spark, con, data):
    encoding = Encoder(read_ranks(vocabulary("byte_bpe_50k.tiktoken")), PATTERN).bpe
    want = {k: encoding.encode_ordinary(t or "") for k, t in con.sql("select doc_id, text from documents").fetchall()}
    assert {r.doc_id: list(r.ids) for r in QUERIES["p6_ids"](spark, data).collect()} == want


def test_p7_found_equals_brute_force(spark, con, data):
    def windows(text):
        return {tuple(w[i : i + 12]) for w in readings(text or "") for i in range(len(w) - 11)}

    items = [(k, windows(q) | windows(a)) for k, q, a in con.sql("select item_id, question, anchor from eval_items").fetchall()]
    want = set()
    for doc, text in con.sql("select doc_id, text from documents").fetchall():
        own = windows(text)
        want |= {(item, doc) for item, w in items if not w.isdisjoint(own)}
    got = [tuple(r) for r in QUERIES["p7_found"](spark, data).select("item_id", "doc_id").collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_p8_queries_agree(spark, con, data):
    data = data.replace("sf0.001", "sf0.01")  # the smallest has too few labels
    titles = {s for (s,) in con.sql("select subject from subjects").fetchall()}
    shares = QUERIES["p8_shares"](spark, data).toPandas()
    assert len(shares) and set(shares["subject"]) <= titles
    assert (shares.groupby("doc_id")["share"].sum() - 1).abs().max() < 1e-9
    found = {tuple(r) for r in QUERIES["p8_found"](spark, data).collect()}
    assert found == set(shares[shares["share"] >= 1 / 3 - 1e-9][["doc_id", "subject"]].itertuples(index=False, name=None))
    mixture = QUERIES["p8_mixture"](spark, data).toPandas()
    assert mixture["sentences"].sum() == shares["sentences"].sum() and abs(mixture["share"].sum() - 1) < 1e-9
