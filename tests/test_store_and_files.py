"""Filters, pages, files, search results and ingest on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from groundwork.operators import stats, store
from groundwork.sources import files, search
from groundwork.streaming.ingest import ingest
from groundwork.streaming.order import violations


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "b", None), (4, "a", 9)], "id long, kind string, n int")


@pytest.mark.parametrize(
    ("wanted", "ids"),
    [
        ({"kind": "a"}, {1, 4}), ({"kind": {"$ne": "a"}}, {2, 3}), ({"kind": {"$in": ["a", "b"]}}, {1, 3, 4}), ({"kind": {"$nin": ["a"]}}, {2, 3}),
        ({"kind": {"$nin": []}}, {1, 2, 3, 4}), ({"kind": {"$in": []}}, set()), ({"n": {"$gte": 7, "$lt": 9}}, {2}), ({"n": {"$exists": False}}, {3}), ({}, {1, 2, 3, 4}),
        ({"kind": {"$in": [None, "b"]}}, {2, 3}), ({"kind": {"$ne": None}}, {1, 3, 4}),
    ],
)
def test_conditions(items, wanted, ids):
    assert {r.id for r in items.where(store.condition(wanted)).collect()} == ids


def test_unknown_operator(items):
    with pytest.raises(ValueError):
        store.condition({"n": {"$regex": "x"}})


def test_page(items):
    got = store.page(items, {}, "n", "id", limit=2, offset=1).collect()
    assert [(r.id, r.total) for r in got] == [(2, 4), (1, 4)]


def test_percentiles_and_empty(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 5)], "v int")
    assert stats.percentile_floor(df, [], "v", 50).first().p50 == 3 and stats.percentile_nearest(df, [], "v", 95).first().p95 == 4
    assert stats.percentile_nearest(df.limit(0), [], "v", 95).count() == 0


def test_collection_last_wins_and_damaged_is_found(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x", "n": 1}\n{"id": "x", "n": 2}\n{broken\n{"id": "y", "n": 3}\n')
    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    assert {(r.id, r.n) for r in files.collection(spark, str(tmp_path), schema).collect()} == {("x", 2), ("y", 3)}
    assert [r.line for r in files.damaged(spark, str(tmp_path)).collect()] == ["{broken"]


def test_gold_fails_at_a_bad_line(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": 1}\n{bad\n')
    with pytest.raises(Exception):  # noqa: B017
        files.gold(spark, str(tmp_path / "g.jsonl"), "id long").collect()


def test_logs_exports_and_uploads(spark, tmp_path, items):
    files.append_log(items, str(tmp_path / "log"))
    files.append_log(items, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 8
    files.export_runs(items, str(tmp_path / "out"), "kind")
    assert spark.read.parquet(str(tmp_path / "out")).where("population = 'a'").count() == 2
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "x.PDF").write_bytes(b"%PDF")
    (tmp_path / "up" / "y.bin").write_bytes(b"1")
    assert {r.kind for r in files.uploads(spark, str(tmp_path / "up")).select("kind").collect()} == {"pdf", None}
    assert files.newest(spark, str(tmp_path / "up")).first().path


def test_upsert_by_key(spark, items):
    new = spark.createDataFrame([(1, "z", 0), (9, "z", 0)], "id long, kind string, n int")
    assert {(r.id, r.kind) for r in files.upsert_by_key(items, new, "id").collect()} == {(1, "z"), (2, None), (3, "b"), (4, "a"), (9, "z")}


def test_event_frames(spark):
    df = spark.createDataFrame([(1, ": hi\n\nevent: a\ndata: 1\ndata: 2\n\ndata: x\r\n\r\n")], "k int, t string")
    assert [(r.event, r.data) for r in files.event_frames(df, "k", "t").orderBy("seq").collect()] == [("a", "1\n2"), ("message", "x")]


def test_search_source_and_failover(spark, tmp_path):
    rows = [("q", 1, "t", "https://a.org/", "s", None), ("r", 1, "t", "https://b.org/", "s", None)]
    spark.createDataFrame(rows, search.SCHEMA).write.parquet(str(tmp_path / "p"))
    search.register(spark)
    one = spark.read.format("search_results").option("path", str(tmp_path / "p")).load()
    two = one.withColumn("query", F.lit("z")).limit(1)
    got = search.failover([("first", one.where("query = 'q'")), ("second", one.unionByName(two))])
    assert {(r.query, r.provider) for r in got.collect()} == {("q", "first"), ("r", "second"), ("z", "second")}


def test_order_violations(spark):
    rows = [(1, 1, "plan"), (1, 2, "sources"), (1, 3, "token"), (1, 4, "done"), (2, 1, "token"), (2, 2, "plan"), (3, 1, "sources"), (3, 2, "done"), (3, 3, "done")]
    got = {(r.run, r.rule) for r in violations(spark.createDataFrame(rows, "run int, seq int, kind string"), "run", "seq", "kind").collect()}
    assert got == {(2, "token_before_sources"), (2, "plan_not_first"), (3, "event_after_done"), (3, "more_than_one_done")}


def test_ingest(spark, tmp_path):
    rows = [(1, "A text about compilers. " * 20, dt.datetime(2024, 1, 1)), (2, "short", None), (3, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, at timestamp").parquet(str(tmp_path / "in"))
    ingest(stream, "doc_id", "text", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.doc_id: r.status for r in spark.read.parquet(str(tmp_path / "out/status")).collect()}
    assert got == {1: "indexed", 2: "empty", 3: "empty"}
