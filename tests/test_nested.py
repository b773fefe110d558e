"""Nested records in every shape they are written in."""

import json

from groundwork.operators.nested import Child, child_table, link_table, record_column, unnest

FIELDS = ["tools", "warnings", "phases_ms", "cache", "route"]
CHILDREN = [
    Child("tools", "tools"),
    Child("attempts", "attempts", within="tools"),
    Child("warnings", "warnings", scalar=True),
    Child("phases_ms", "phases_ms", kind="names"),
    Child("by_namespace", "cache.by_namespace", kind="names", keep_null=True),
]
RECORD = {
    "route": "web",
    "tools": [{"name": "a", "ms": 1, "attempts": [{"ms": 2}, None, {"ms": 3}]}, None, {"name": "b", "ms": "7"}],
    "warnings": ["x", None, "y"],
    "phases_ms": {"one": 1, "two": None},
    "cache": {"by_namespace": {"s": {"hits": 1}, "t": None}},
}
LINKS = {("tools", "0"), ("tools", "2"), ("attempts", "0.0"), ("attempts", "0.2"), ("warnings", "0"), ("warnings", "2"), ("phases_ms", "one"), ("by_namespace", "s"), ("by_namespace", "t")}


def links(spark, payloads):
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "id long, payload string, record string")
    nested = unnest(df, "id", "payload", FIELDS, CHILDREN)
    out = {}
    for r in link_table(nested, "id", [c.name for c in CHILDREN]).collect():
        out.setdefault(r.id, set()).add((r.child, r.child_key))
    return out


def test_shapes_come_to_the_same(spark):
    keyed = RECORD | {"tools": {str(i): t for i, t in enumerate(RECORD["tools"])}}
    encoded = RECORD | {"tools": json.dumps(RECORD["tools"]), "phases_ms": json.dumps(RECORD["phases_ms"])}
    plain = json.dumps(RECORD)
    payloads = [
        plain, "﻿" + plain + "\n", json.dumps(plain), json.dumps({"v": 2, "run": RECORD}), json.dumps({"data": {"kind": "k", "attributes": RECORD}}),
        json.dumps([RECORD]), json.dumps(json.dumps([{"v": 1, "run": RECORD}])), json.dumps(keyed), json.dumps(encoded), json.dumps(RECORD, indent=1),
    ]
    got = links(spark, payloads)
    assert all(got[i] == LINKS for i in range(len(payloads)))


def test_single_entries(spark):
    got = links(spark, [json.dumps({"tools": RECORD["tools"][0], "warnings": "late"})])
    assert got[0] == {("tools", "0"), ("attempts", "0.0"), ("attempts", "0.2"), ("warnings", "0")}


def test_damaged_empty_and_null_give_nothing(spark):
    plain = json.dumps(RECORD)
    assert links(spark, [None, "", "  ", plain[:-5], plain[: len(plain) // 2], "error: no body", "null", "[]", "17", "{}", '"text"', json.dumps([RECORD, RECORD])]) == {}


def test_typed_children_and_empty_table(spark):
    df = spark.createDataFrame([(1, json.dumps(RECORD))], "id long, payload string")
    nested = unnest(df, "id", "payload", FIELDS, CHILDREN)
    rows = child_table(nested, "id", "tools", {"name": "string", "ms": "bigint"}, doubled="try_cast(f['ms'] as bigint) * 2").orderBy("child_key").collect()
    assert [(r.child_key, r.name, r.ms, r.doubled) for r in rows] == [("0", "a", 1, 2), ("2", "b", 7, 14)]
    assert nested.select(record_column("route", "string").alias("r")).first().r == "web"
    assert unnest(df.limit(0), "id", "payload", FIELDS, CHILDREN).count() == 0


def test_any_number_of_wrappers(spark):
    payloads = []
    for depth in (4, 5, 6, 7, 12, 40):
        value = RECORD
        for i in range(depth):
            value = [value] if i % 2 else {"v": i, "data": value}
        payloads.append(json.dumps(value))
    value = json.dumps(RECORD)
    for i in range(7):
        value = json.dumps({"v": i, "data": value})
    payloads.append(value)
    got = links(spark, payloads)
    assert all(got.get(i) == LINKS for i in range(len(payloads)))
