"""Nested semi-structured records as flat tables that keep the links between parents and children.

Everything is one projection of higher-order functions: nested transforms attach the ancestors' keys and positions, flatten
joins the arrays of one level, and one inline per target table emits its rows. No shuffle is needed, and a level is parsed
once, into the texts of its parts.

Records may be written in several shapes, which come to the same: wrapped in objects or one-element lists, or encoded as a
JSON string, whole or by field; a list may be keyed by position or stand as a single entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers that are tried around every record; only payloads that need more go on, as far as their length allows.
WRAPPERS = 6
_OPTIONS = "map('allowSingleQuotes', 'false')"


@dataclass(frozen=True)
class Child:
    """A child table: where its entries stand in the record, and what holds them."""

    name: str
    path: str
    kind: str = "list"  # list: entries with positions; names: an object's keys
    scalar: bool = False  # entries of the list are no objects, so an object in its place is keyed by entry
    within: str | None = None  # another Child, of whose entries each may hold a list at path
    keep_null: bool = False


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once, as name within body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _object(text: str) -> str:
    return f"from_json({text}, 'map<string,string>', {_OPTIONS})"


def _list(text: str) -> str:
    return f"from_json({text}, 'array<string>', {_OPTIONS})"


def _first(text: str) -> str:
    return f"substr(ltrim({text}), 1, 1)"


def _layer(fields: list[str]) -> str:
    """One layer less around a record: a string is decoded, a list of one opened, an object without any of the record's
    fields replaced by its only part that is an object or a list."""
    known = "array(" + ", ".join(f"'{f}'" for f in fields) + ")"
    none = "cast(null as string)"
    end = f"named_struct('text', {none}, 'fields', cast(null as map<string,string>))"
    more = lambda t: f"named_struct('text', {t}, 'fields', cast(null as map<string,string>))"
    parts = f"filter(map_values(m), p -> {_first('p')} in ('{{', '['))"
    opened = _let(_list("acc.text"), "l", f"case when size(l) = 1 then {more('l[0]')} else {end} end")
    entered = _let(
        _object("acc.text"),
        "m",
        f"case when m is null then {end} when arrays_overlap(map_keys(m), {known}) then named_struct('text', {none}, 'fields', m)"
        f" else {_let(parts, 'q', f'case when size(q) = 1 then {more("q[0]")} else named_struct({chr(39)}text{chr(39)}, {none}, {chr(39)}fields{chr(39)}, m) end')} end",
    )
    decoded = more("from_json(concat('[', acc.text, ']'), 'array<string>', " + _OPTIONS + ")[0]")
    return (
        f"case when acc.text is null then acc when {_first('acc.text')} = '\"' then {decoded}"
        f" when {_first('acc.text')} = '[' then {opened} when {_first('acc.text')} = '{{' then {entered} else {end} end"
    )


def _entries(text: str, scalar: bool, keep_null: bool) -> str:
    """array<struct<k string, v string>> of a list, of a list keyed by name or position, or of an entry that stands alone."""
    one = "array(named_struct('k', '0', 'v', t))"
    listed = _let(_list("t"), "l", f"case when l is null then {one} else transform(l, (e, i) -> named_struct('k', cast(i as string), 'v', e)) end")
    is_keyed = "m is not null" if scalar else f"m is not null and forall(map_values(m), p -> p is null or {_first('p')} = '{{')"
    keyed = _let(_object("t"), "m", f"case when {is_keyed} then transform(map_entries(m), e -> named_struct('k', e.key, 'v', e.value)) else {one} end")
    out = _let(
        text,
        "t",
        f"case when t is null then array() when {_first('t')} = '[' then {listed} when {_first('t')} = '{{' then {keyed} else {one} end",
    )
    return out if keep_null else f"filter({out}, e -> e.v is not null)"


def _names(text: str, keep_null: bool) -> str:
    entries = f"coalesce(transform(map_entries({_object(text)}), e -> named_struct('k', e.key, 'v', e.value)), array())"
    return entries if keep_null else f"filter({entries}, e -> e.v is not null)"


def _at(fields: str, path: str) -> str:
    """The text at a dotted path below a map of texts."""
    head, *rest = path.split(".")
    out = f"{fields}['{head}']"
    for step in rest:
        out = f"{_object(out)}['{step}']"
    return out


def unnest(df: DataFrame, key: str, payload: str, fields: list[str], children: list[Child]) -> DataFrame:
    """(key, record map<string,string>, one array<struct<k, v>> column per child) of every payload that reads as a record.

    A null, empty or damaged payload, and one whose record isn't an object, gives no row. A byte order mark and space
    around the payload are passed over, and any number of wrappers around the record that can be read as JSON. ``k`` is an entry's position from 0 or its own key; below another child the
    parent's key, a dot and the entry's. ``v`` is the entry's JSON text, or what a string holds. Null entries count for
    positions and are left out unless keep_null. A key in more than one row gives the rows of each; other columns of df are
    dropped. An empty table gives an empty table.
    """
    text = F.expr(f"regexp_replace(`{payload}`, '^[\\\\uFEFF\\\\s]+|\\\\s+$', '')")
    start = "named_struct('text', _text, 'fields', cast(null as map<string,string>))"
    layer = _layer(fields)
    first = f"aggregate(sequence(1, {WRAPPERS}), {start}, (acc, i) -> {layer})"
    # a wrapper takes two characters at least
    rest = f"aggregate(sequence(1, 1 + length(some.text) div 2), some, (acc, i) -> {layer}, acc -> acc.fields)"
    layers = _let(first, "some", f"case when some.text is null then some.fields else {rest} end")
    base = df.select(F.col(key), text.alias("_text")).select(key, F.expr(layers).alias("record")).where("record is not null")
    columns = [F.col(key), F.col("record")]
    by_name = {c.name: c for c in children}
    for c in children:
        if c.kind == "names":
            sql = _names(_at("record", c.path), c.keep_null)
        elif c.within:
            inner = _entries(_at(_object("p.v"), c.path), c.scalar, c.keep_null)
            outer = _entries(_at("record", by_name[c.within].path), False, False)
            sql = f"flatten(transform({outer}, p -> transform({inner}, a -> named_struct('k', concat(p.k, '.', a.k), 'v', a.v))))"
        else:
            sql = _entries(_at("record", c.path), c.scalar, c.keep_null)
        columns.append(F.expr(sql).alias(c.name))
    return base.select(*columns)


def child_table(nested: DataFrame, key: str, name: str, fields: dict[str, str], **columns: str) -> DataFrame:
    """The rows of one child: the record's key, the child's, its fields by type, and columns by SQL over ``child_key`` and
    the map of texts ``f``; a value that doesn't cast is null."""
    rows = nested.select(key, F.expr(f"inline({name})").alias("child_key", "v"))
    rows = rows.withColumn("f", F.expr(_object("v")))
    typed = [F.expr(f"try_cast(f['{n}'] as {kind})").alias(n) for n, kind in fields.items()]
    return rows.select(key, "child_key", *typed, *[F.expr(sql).alias(out) for out, sql in columns.items()])


def link_table(nested: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, child, child_key) of every row of every child table, in one pass."""
    parts = ", ".join(f"transform({n}, e -> named_struct('child', '{n}', 'child_key', e.k))" for n in names)
    return nested.select(key, F.expr(f"inline(flatten(array({parts})))"))


def record_column(path: str, kind: str) -> Column:
    """A field of the record map by type; a number written as a string counts."""
    return F.expr(f"try_cast({_at('record', path)} as {kind})")
