"""The contract of an ordered event stream: what must come before what, checked per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(events: DataFrame, run: str, seq: str, kind: str) -> DataFrame:
    """(run, rule) of runs whose events break the order: plan first if there is one, sources before any token, nothing after
    done, and at most one done."""
    first = lambda k: F.min(F.when(F.col(kind) == k, F.col(seq)))
    by = events.groupBy(run).agg(
        F.min(seq).alias("start"), F.max(seq).alias("end"), first("plan").alias("plan"), first("sources").alias("sources"), first("token").alias("token"),
        first("done").alias("done"), F.count_if(F.col(kind) == "done").alias("dones"),
    )
    rules: dict[str, Column] = {
        "plan_not_first": F.col("plan") > F.col("start"),
        "token_before_sources": F.col("token").isNotNull() & (F.col("sources").isNull() | (F.col("token") < F.col("sources"))),
        "event_after_done": F.col("end") > F.col("done"),
        "more_than_one_done": F.col("dones") > 1,
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return by.select(run, F.explode(broken).alias("rule"))


def replay(events: DataFrame, run: str, seq: str, after: int) -> DataFrame:
    """The events of every run after a sequence number, in order."""
    return events.where(F.col(seq) > after).withColumn("nth", F.row_number().over(Window.partitionBy(run).orderBy(seq)))
