"""Every core query runs, and those with SQL give what DuckDB gives."""

import re

import pytest
from oracle import check, connect

from groundwork.plans.chunks import page_chunks
from groundwork.queries import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()

_count = lambda sql: lambda con: con.sql(f"select count(*) from {sql}").fetchall()[0][0]
_memories = "documents where source = 'memory' and trim(text, ' \t\r\n') <> ''"
_answers = "documents where source = 'answer' and text is not null"


def _chunks(row: tuple) -> int:
    """Pages of 3000 characters, each in pieces of its own; blank and short ones are none."""
    flat = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", row[0].replace("\r\n", "\n"))).strip()
    return len(page_chunks([(n, None, flat[i : i + 3000]) for n, i in enumerate(range(0, len(flat), 3000), 1)]))


#: Rows that the queries without SQL have; what is in them is tested beside their operators.
WITHOUT_SQL = {
    "answer_validation": _count(_answers), "groundedness_summary": lambda con: 1, "memory_near": _count(_memories),
    "extractive_answers": lambda con: 320, "chunk_pages": lambda con: sum(map(_chunks, con.sql("select text from documents where text is not null").fetchall())),
}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    if name in SQL:
        check(spark, con, QUERIES[name], SQL[name], data)
    else:
        assert QUERIES[name](spark, data).count() == WITHOUT_SQL[name](con)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
