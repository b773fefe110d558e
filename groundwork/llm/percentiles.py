"""Exact percentiles per group over any number of rows, by bisection.

For every group and percentile an interval of values is kept that holds the value of the target rank. A pass over the rows
counts, for each interval, the rows between successive midpoints, together with the least and greatest value among them. The
part that holds the rank becomes the next interval, down to those two values; where they are equal, the rank is resolved.
Counts are sums, so partitions and days combine without loss, and a group of any size is never gathered anywhere.

Midpoints halve the order of the representable numbers, not their values: a double's sign, exponent and fraction are read as
one whole number of 64 bits that grows with it. So every pass settles as many bits as it has midpoints for, whatever the
range of the values, and the number of passes is bounded by 64 of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.runtime import broadcast_if_small, durable, release

#: Midpoints per interval and pass; 1 is plain bisection. A pass settles one bit for every doubling of these and one more.
MIDPOINTS = 1023

_FRACTION = 1 << 52
_LEAST_EXPONENT = -1022


def with_order(df: DataFrame, v: str, name: str) -> DataFrame:
    """df with a whole number for every finite double of column v, as far from 0 as there are doubles between; it grows with it.

    That is the double's bits without the sign, times the sign. All steps are exact: the logarithm is off by one place at
    most, which the comparisons mend, and the other factors are powers of two. Each step is a column of its own, so that the
    logarithm and the power are taken once a row.
    """
    size, guess, power = F.abs(F.col(v)), F.col("_guess"), F.col("_power")
    exponent = F.floor(F.log2(F.greatest(size, F.lit(2.0**_LEAST_EXPONENT))))
    df = df.withColumn("_guess", F.greatest(F.least(exponent, F.lit(1023)), F.lit(_LEAST_EXPONENT)).cast("int"))
    df = df.withColumn("_power", F.pow(F.lit(2.0), guess.cast("double")))
    less, more = size < power, size / 2 >= power
    mended = {"_power": F.when(less, power / 2).when(more, power * 2).otherwise(power), "_guess": F.when(less, guess - 1).when(more, guess + 1).otherwise(guess)}
    df = df.withColumns(mended)
    normal = (guess + 1022).cast("long") * _FRACTION + (size / power * float(_FRACTION)).cast("long")
    subnormal = (size * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(size < 2.0**_LEAST_EXPONENT, subnormal).otherwise(normal)
    return df.withColumn(name, F.when(F.col(v) < 0, -bits).otherwise(bits)).drop("_guess", "_power")


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: list[float], midpoints: int = MIDPOINTS) -> DataFrame:
    """keys, ``percentile`` double, ``value`` double and ``n`` long, one row per group and wanted percentile.

    The p-th percentile is the smallest value with at least p % of the group's values at or below it; it's exact. Values
    that are null, NaN or infinite are left out, negative ones count, and a group without others has no row. A null key is
    a group. Repeated rows count each; an empty table gives an empty one; columns of df beside keys and value don't matter.
    """
    if midpoints < 1:
        raise ValueError("a pass needs at least one midpoint")
    bits = (midpoints + 1).bit_length() - 1
    names = [f"g{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], (v + F.lit(0.0)).alias("v"))
    rows = durable(with_order(rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))), "v", "o"))
    wide = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi"), F.max("v").alias("value"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") / 100 - 1e-9)).cast("long")
    targets = durable(wide.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in wanted]))).withColumn("k", rank))
    done = targets.where("lo = hi")
    while not (targets := targets.where("lo < hi")).isEmpty():
        targets = _narrow(rows, targets, names, bits)
        done = done.unionByName(targets.where("lo = hi"))
    release(rows)
    return done.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("p").alias("percentile"), "value", "n")


def _narrow(rows: DataFrame, targets: DataFrame, names: list[str], bits: int) -> DataFrame:
    """One pass: the targets with the interval that is left of theirs, and the rank within it.

    The parts of an interval are its numbers by their leading places, down to the place that leaves 2**bits parts at most.
    A part is then a block of numbers that differ below that place alone, so the next pass goes on at least bits lower.
    """
    # other names than the rows have: both come from one table
    sides = [f"i_{n}" for n in names]
    place = F.expr(f"array_min(filter(sequence(0, 63), s -> cast(shiftright(hi, s) as decimal(20, 0)) - cast(shiftright(lo, s) as decimal(20, 0)) < {1 << bits}))")
    intervals = targets.select(*[F.col(n).alias(s) for n, s in zip(names, sides, strict=True)], "lo", "hi", place.alias("place")).distinct()
    on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(s)) for n, s in zip(names, sides, strict=True)])
    inside = rows.join(broadcast_if_small(intervals, *sides), on & F.col("o").between(F.col("lo"), F.col("hi")))
    counted = inside.groupBy(*names, "lo", "hi", F.expr("shiftright(o, place)").alias("part")).agg(
        F.count("*").alias("c"), F.min("o").alias("least"), F.max("o").alias("most"), F.max("v").alias("greatest")
    )
    up_to = F.sum("c").over(Window.partitionBy(*names, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("upto", up_to).withColumn("before", F.col("upto") - F.col("c"))
    t, c = targets.alias("t"), counted.alias("c")
    hit = reduce(lambda x, y: x & y, [F.col(f"t.{n}").eqNullSafe(F.col(f"c.{n}")) for n in [*names, "lo", "hi"]])
    hit = hit & (F.col("t.k") > F.col("c.before")) & (F.col("t.k") <= F.col("c.upto"))
    return durable(
        t.join(c, hit).select(
            *[F.col(f"t.{n}").alias(n) for n in names], "t.n", F.col("c.least").alias("lo"), F.col("c.most").alias("hi"),
            F.col("c.greatest").alias("value"), "t.p", (F.col("t.k") - F.col("c.before")).alias("k"),
        )
    )
