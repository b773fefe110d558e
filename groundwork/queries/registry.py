"""All queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwork.queries import answers, audit, evidence, problems, retrieval, state, stats, store, streams, text

MODULES = [problems, text, store, stats, retrieval, evidence, state, streams, answers, audit]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Questions answered end to end: retrieved, cited, validated against the sources, one row per question."""
    return answers.extractive_answers(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
