"""A document store's verbs on DataFrames: filters given as data, pages, upserts, patches and deletes that cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGES = {"$gte": "__ge__", "$lte": "__le__", "$gt": "__gt__", "$lt": "__lt__"}


def compact(conditions: dict) -> dict:
    """Without the fields on which there is no condition."""
    return {k: v for k, v in conditions.items() if v is not None}


def condition(conditions: dict) -> Column:
    """A predicate that is true or false, never null: all fields must match.

    A missing (null) value fails equality, $in and ranges, and passes $ne and $nin, unless null is what they name. $exists
    asks whether there is a value. An unknown operator is an error rather than a filter that passes too much.
    """
    parts: list[Column] = []
    for field, wanted in conditions.items():
        c = F.col(field)
        if not isinstance(wanted, dict):
            parts.append(c.eqNullSafe(F.lit(wanted)))
            continue
        for op, x in wanted.items():
            if op in ("$in", "$nin"):
                among = c.isin([v for v in x if v is not None]) if any(v is not None for v in x) else F.lit(False)
                hit = F.coalesce(among, F.lit(False)) | (c.isNull() if None in x else F.lit(False))
                parts.append(hit if op == "$in" else ~hit)
            elif op == "$ne":
                parts.append(~c.eqNullSafe(F.lit(x)))
            elif op == "$exists":
                parts.append(c.isNotNull() if x else c.isNull())
            elif op in _RANGES:
                parts.append(F.coalesce(getattr(c, _RANGES[op])(F.lit(x)), F.lit(False)))
            else:
                raise ValueError(f"unknown filter operator {op}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def find(df: DataFrame, conditions: dict) -> DataFrame:
    return df.where(condition(compact(conditions)))


def page(df: DataFrame, conditions: dict, sort: str, key: str, limit: int = 100, offset: int = 0, descending: bool = True) -> DataFrame:
    """A page of the matching rows and, in ``total``, their number. Rows without the sort value come as the least; equal ones
    by key. The page is a top-k, and the total a count that needs no sort."""
    found = find(df, conditions)
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first()
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(order, F.col(key)).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def upsert(old: DataFrame, new: DataFrame, key: str, created: str, updated: str, now: Column) -> DataFrame:
    """old with the rows of new merged in by key: given values replace, others stay; the first ``created`` stands."""
    others = [c for c in old.columns if c not in (key, created, updated)]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    touched = F.col(f"n.{key}").isNotNull()
    merged = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in others]
    return both.select(
        F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key),
        *merged,
        F.coalesce(F.col(f"o.{created}"), now).alias(created),
        F.when(touched, now).otherwise(F.col(f"o.{updated}")).alias(updated),
    )


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the non-null values of changes; keys that old doesn't have are passed over."""
    o, n = old.alias("o"), changes.alias("n")
    columns = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in changes.columns and c != key else F.col(f"o.{c}").alias(c) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "left").select(*columns)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given parents."""
    keys = gone.select(key).distinct()
    return parents.join(keys, key, "left_anti"), children.join(keys.withColumnRenamed(key, child_key), child_key, "left_anti")


def owned(df: DataFrame, owner: str, user: str) -> DataFrame:
    """A wrong owner's rows are as good as absent."""
    return df.where(F.col(owner).eqNullSafe(F.lit(user)))


def keep_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by order, by a partial aggregation rather than a sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(order)).alias("_r")).select(key, "_r.*")
