"""Statistics of run logs, as aggregations that Spark combines before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.runtime import broadcast_if_small, durable

# Two-sided 95 % quantiles of Student's t for 1 to 9 degrees of freedom; beyond, the normal one.
T_95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262]
Z_95 = 1.96


def rounded(x: Column, places: int) -> Column:
    """Half up, by one formula on every engine."""
    scale = 10.0**places
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, n, and for each name the value at a 1-based rank that is computed from the group's count ``n``.

    Values are counted first, so that a group of any size becomes as many rows as it has distinct values. These are spread by
    range, whatever their group; only sums by slice come together to say in which slice a rank lies, and only that slice is
    counted through. Null values are left out, a null key is a group, and an empty table gives an empty one.
    """
    names = [f"_g{i}" for i in range(len(keys))]
    given = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(g) for k, g in zip(keys, names, strict=True)], F.col(value).alias("_v"))
    counts = durable(given.agg(F.count("*").alias("_c")).repartitionByRange(*names, "_v").withColumn("_slice", F.spark_partition_id()))
    group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    slices = counts.groupBy(*names, "_slice").agg(F.sum("_c").alias("_in"))
    slices = slices.withColumn("n", F.sum("_in").over(group)).withColumn("_upto", F.sum("_in").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    held = slices.withColumn("_want", wanted).where((F.col("_want.rank") <= F.col("_upto")) & (F.col("_want.rank") > F.col("_upto") - F.col("_in")))
    held = held.select(*[F.col(g).alias(f"{g}h") for g in names], F.col("_slice").alias("_at"), "n", (F.col("_upto") - F.col("_in")).alias("_before"), "_want")
    on = F.col("_slice") == F.col("_at")
    for g in names:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}h"))
    within = Window.partitionBy(*names, "_slice", "_want").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.join(broadcast_if_small(held), on).withColumn("_to", F.col("_before") + F.sum("_c").over(within))
    hit = run.where((F.col("_to") >= F.col("_want.rank")) & (F.col("_to") - F.col("_c") < F.col("_want.rank")))
    by = hit.groupBy(*names).agg(*[F.max(F.when(F.col("_want.name") == name, F.col("_v"))).alias(name) for name in ranks], F.max("n").alias("n"))
    by = by if names else by.where("n is not null")
    return by.select(*[F.col(g).alias(k) for k, g in zip(keys, names, strict=True)], *ranks, "n")


def percentile_floor(df: DataFrame, keys: list[str], value: str, *ps: int) -> DataFrame:
    """sorted[min(n - 1, floor(p n / 100))], as p50 and so on."""
    return at_ranks(df, keys, value, {f"p{p}": F.least(F.col("n"), F.floor(F.col("n") * p / 100) + 1) for p in ps})


def percentile_nearest(df: DataFrame, keys: list[str], value: str, *ps: int) -> DataFrame:
    """The nearest rank: the ceil(p n / 100)-th value, as p50 and so on."""
    return at_ranks(df, keys, value, {f"p{p}": F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100)) for p in ps})


def t_interval(value: str) -> list[Column]:
    """n, mean and a 95 % interval of the mean; without bounds below two values."""
    x = F.col(value).cast("double")
    n, mean, sd = F.count(x), F.avg(x), F.stddev_samp(x)
    t = F.lit(Z_95)
    for df, quantile in reversed(list(enumerate(T_95, 1))):
        t = F.when(n - 1 == df, quantile).otherwise(t)
    half = F.when(n >= 2, t * sd / F.sqrt(n))
    return [n.alias("n"), mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high")]


def wilson(passed: Column) -> list[Column]:
    """n, rate and a 95 % Wilson interval of a yes or no; nulls aren't counted."""
    n, k, z2 = F.count(passed), F.count_if(passed), Z_95**2
    p = k / n
    centre, width = (p + z2 / (2 * n)) / (1 + z2 / n), Z_95 / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), centre - width), F.least(F.lit(1.0), centre + width)
    return [n.alias("n"), F.when(n > 0, p).alias("rate"), F.when(n > 0, low).alias("low"), F.when(n > 0, high).alias("high")]


def hit_rate(hits: Column, misses: Column) -> Column:
    return rounded(F.when(hits + misses > 0, hits / (hits + misses)), 3)


def longest_streak(df: DataFrame, key: str, calls: str, name: str) -> DataFrame:
    """Per row of sequences the longest run of one name, folded within the array."""
    fold = (
        f"aggregate({calls}, named_struct('prev', cast(null as string), 'run', 0, 'most', 0), (acc, c) -> named_struct('prev', c.{name},"
        f" 'run', if(c.{name} <=> acc.prev, acc.run + 1, 1), 'most', greatest(acc.most, if(c.{name} <=> acc.prev, acc.run + 1, 1))), acc -> acc.most)"
    )
    return df.select(key, F.expr(f"coalesce({fold}, 0)").alias("streak"))
