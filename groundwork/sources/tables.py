"""The tables that queries read: one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key with the given columns: a redelivered row repeats an id, and the latest delivery stands.

    Rows without a key are left out. Ties of ``ingested_at`` carry the same content, so either stands.
    """
    kept = [c for c in columns if c != key]
    latest = F.max_by(F.struct(*[F.col(c) for c in kept]), F.col("ingested_at")) if kept else F.lit(None)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(latest.alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in kept])
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, whatever the session's time zone for the latter."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
