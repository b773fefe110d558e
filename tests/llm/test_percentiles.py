"""Percentiles by bisection are the exact ones."""

import math
import random

import pytest

from groundwork.llm.percentiles import percentiles, with_order


def exact(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(p * len(values) / 100 - 1e-9)) - 1]


@pytest.mark.parametrize("midpoints", [15, 1023])
def test_exact(spark, midpoints):
    rng = random.Random(2)
    groups = {"even": [rng.random() for _ in range(501)], "heavy": [rng.paretovariate(0.5) for _ in range(400)], "ties": [3.0] * 50 + [7.0] * 50, "one": [5e-324], "wide": [0.0, 1e308, 1.0, 1e-300], "signed": [-1e308, -2.5, -5e-324, -0.0, 3.0, 1.7976931348623157e308], None: [2.0, 1.0]}
    bad = [("even", None), ("even", math.nan), ("even", math.inf), ("even", -math.inf), ("none", None)]
    rows = [(g, v) for g, vs in groups.items() for v in vs] + bad
    rng.shuffle(rows)
    df = spark.createDataFrame([(g, v, 0.0, 1) for g, v in rows], "g0 string, x double, lo double, n int")
    ps = [0.0, 1.0, 50.0, 95.0, 99.9, 100.0]
    got = {(r.g0, r.percentile): (r.value, r.n) for r in percentiles(df, ["g0"], "x", ps, midpoints).collect()}
    assert got == {(g, p): (exact(vs, p), len(vs)) for g, vs in groups.items() for p in ps}


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert percentiles(df, ["g"], "x", [50]).count() == 0


def test_values_of_any_range_take_few_passes(spark, monkeypatch):
    from groundwork.llm import percentiles as module

    passes = []
    narrow = module._narrow
    monkeypatch.setattr(module, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    powers = {"both": [2.0**e for e in range(-1000, 1001)], "small": [2.0**e for e in range(-1000, 1)], "signed": [s * 2.0**e for e in range(-900, 900) for s in (-1, 1)]}
    df = spark.createDataFrame([(g, v) for g, vs in powers.items() for v in vs], "g string, x double")
    got = {(r.g, r.percentile): r.value for r in percentiles(df, ["g"], "x", [1, 50]).collect()}
    assert got == {(g, p): exact(vs, p) for g, vs in powers.items() for p in (1, 50)}
    assert len(passes) <= 7


def test_order_of_doubles(spark):
    import struct

    rng = random.Random(3)
    values = [s * x for e in range(-1074, 1024) for x in (2.0**e, math.nextafter(2.0**e, 0), math.nextafter(2.0**e, math.inf)) for s in (-1, 1)]
    values += [v for v in (struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(5000)) if math.isfinite(v)]
    bits = lambda v: struct.unpack("q", struct.pack("d", abs(v)))[0] * (-1 if v < 0 else 1)
    rows = with_order(spark.createDataFrame([(v,) for v in values], "v double"), "v", "o").collect()
    assert all(r.o == bits(r.v) for r in rows)
