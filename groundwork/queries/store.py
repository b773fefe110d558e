"""Queries of the document store's verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import store
from groundwork.sources.tables import table

NOW = "2026-01-01 00:00:00"


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"), "o_orderdate")


def _with(conditions: dict):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return store.find(_orders(spark, folder), conditions).select("o_orderkey", "priority", "o_totalprice")

    return run


FILTERS = {
    "store_filter_eq": ({"o_orderstatus": "O"}, "o_orderstatus = 'O'"),
    "store_filter_in": ({"priority": {"$in": ["1-URGENT", "2-HIGH"]}}, "coalesce(priority in ('1-URGENT', '2-HIGH'), false)"),
    "store_filter_nin": ({"priority": {"$nin": ["1-URGENT"]}}, "(priority is null or priority <> '1-URGENT')"),
    "store_filter_ne": ({"priority": {"$ne": "2-HIGH"}}, "priority is distinct from '2-HIGH'"),
    "store_filter_exists": ({"priority": {"$exists": False}}, "priority is null"),
    "store_filter_range": ({"o_totalprice": {"$gte": 1000.0, "$lt": 50000.0}, "o_orderstatus": "F"}, "o_totalprice >= 1000 and o_totalprice < 50000 and o_orderstatus = 'F'"),
}


def store_list_page(spark: SparkSession, folder: str) -> DataFrame:
    got = store.page(_orders(spark, folder), {"o_orderstatus": "O", "priority": None}, "o_totalprice", "o_orderkey", limit=50, offset=20)
    return got.select("o_orderkey", "o_totalprice", "total")


def store_count(spark: SparkSession, folder: str) -> DataFrame:
    return store.find(_orders(spark, folder), {"priority": {"$exists": True}}).agg(F.count("*").alias("n"))


def store_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """All orders, and as many changes under twice their keys: about half of these are there, the others are new."""
    old = _orders(spark, folder).withColumn("created_at", F.col("o_orderdate")).withColumn("updated_at", F.col("o_orderdate"))
    old = old.drop("o_orderdate", "o_custkey")
    new = _orders(spark, folder).select(F.expr("o_orderkey * 2 as o_orderkey"), F.lit("X").alias("o_orderstatus"), F.expr("case when o_orderkey % 4 = 0 then o_totalprice + 1 end").alias("o_totalprice"))
    return store.upsert(old, new, "o_orderkey", "created_at", "updated_at", F.lit(NOW).cast("timestamp_ntz"))


def store_patch(spark: SparkSession, folder: str) -> DataFrame:
    old = _orders(spark, folder).select("o_orderkey", "o_orderstatus", "priority")
    changes = _orders(spark, folder).select(F.expr("o_orderkey * 2 as o_orderkey"), F.concat(F.lit("patched "), "o_orderstatus").alias("priority"))
    return store.patch(old, changes, "o_orderkey")


def store_delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    orders = _orders(spark, folder)
    parents, children = store.delete_cascade(orders, table(spark, folder, "lineitem"), orders.where("o_orderstatus = 'F'"), "o_orderkey", "l_orderkey")
    left = parents.agg(F.count("*").alias("n")).select(F.lit("orders").alias("t"), "n")
    return left.unionByName(children.agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("t"), "n"))


def store_latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Of documents with one text the latest, as a reload of a log of versions would keep them."""
    d = table(spark, folder, "documents").where("text is not null").select(F.md5("text").alias("digest"), "doc_id", "source")
    return store.keep_latest(d, "digest", "doc_id")


def store_owned(spark: SparkSession, folder: str) -> DataFrame:
    return store.owned(table(spark, folder, "quick_path"), "user_id", "usr_bench0").select("record_id", "ingested_at")


QUERIES = {name: _with(c) for name, (c, _) in FILTERS.items()} | {
    f.__name__: f for f in (store_list_page, store_count, store_upsert, store_patch, store_delete_cascade, store_latest_wins, store_owned)
}

ORDERS = "(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, nullif(o_orderpriority, '5-LOW') as priority, o_orderdate from orders)"
SQL = {name: f"select o_orderkey, priority, o_totalprice from {ORDERS} where {sql}" for name, (_, sql) in FILTERS.items()} | {
    "store_list_page": f"select o_orderkey, o_totalprice, count(*) over () as total from {ORDERS} where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 50 offset 20",
    "store_count": f"select count(priority) as n from {ORDERS}",
    "store_upsert": f"select coalesce(n.k, o.o_orderkey) as o_orderkey, case when n.k is null then o.o_orderstatus else 'X' end as o_orderstatus, coalesce(n.p, o.o_totalprice) as o_totalprice, o.priority, coalesce(o.o_orderdate, timestamp '{NOW}') as created_at,"
    f" case when n.k is null then o.o_orderdate else timestamp '{NOW}' end as updated_at from {ORDERS} o full join (select o_orderkey * 2 as k, case when o_orderkey % 4 = 0 then o_totalprice + 1 end as p from orders) n on n.k = o.o_orderkey",
    "store_patch": f"select o.o_orderkey, o.o_orderstatus, coalesce('patched ' || n.o_orderstatus, o.priority) as priority from {ORDERS} o left join orders n on n.o_orderkey * 2 = o.o_orderkey",
    "store_delete_cascade": "select 'orders' as t, count(*) as n from orders where o_orderstatus <> 'F' union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')",
    "store_latest_wins": "select md5(text) as digest, max(doc_id) as doc_id, arg_max(source, doc_id) as source from documents where text is not null group by 1",
    "store_owned": "select record_id, ingested_at from quick_path where user_id = 'usr_bench0'",
}
