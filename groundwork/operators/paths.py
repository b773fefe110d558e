"""Prefix joins: the rule that covers a path longest decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_prefix(pages: DataFrame, key: str, host: Column, path: Column, rules: DataFrame) -> DataFrame:
    """(key, allowed) of every page under rules (host, nth, prefix, allow): the longest prefix wins, of equal ones the first;
    without any the page is allowed. The join is on the host, so a page meets only its own site's rules; null prefixes and empty
    ones cover nothing."""
    p = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    r = rules.where("prefix is not null and prefix != ''").select("host", "nth", "prefix", "allow")
    hit = p.join(r, "host").where(F.startswith("path", "prefix"))
    best = hit.groupBy(key).agg(F.max_by("allow", F.struct(F.length("prefix"), -F.col("nth"))).alias("allow"))
    return p.join(best, key, "left").select(key, F.coalesce("allow", F.lit(True)).alias("allowed"))
