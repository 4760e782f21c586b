"""Interval joins against every pair."""

import numpy as np
import pytest

from pulseframe.operators import ranges

P, I = "rec string, at long, tag int", "rec string, lo long, hi long, name string"


def brute(points, intervals, how, first):
    out = []
    for p in points:
        held = [i for i in intervals if None not in (i[0], i[1], i[2], p[0], p[1]) and i[0] == p[0] and i[1] <= p[1] <= i[2]]
        if first:
            held = sorted(held, key=lambda i: (i[1], i[2], i[3]))[:1]
        out += [(*p, *i[1:]) for i in held] or ([(*p, None, None, None)] if how == "left" else [])
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(11)
    points = [(f"r{int(r.integers(3))}", int(r.integers(-50, 5000)), k) for k in range(250)] + [("r0", 100, 1000), ("r0", 100, 1000), (None, 5, 1), ("r1", None, 2), ("lone", 7, 3)]
    lengths = np.r_[r.integers(1, 5, 60), r.integers(1, 200, 60), r.integers(500, 6000, 20)]
    intervals = [(f"r{int(r.integers(3))}", a := int(r.integers(-60, 5000)), a + int(n) - 1, f"i{k % 90}") for k, n in enumerate(lengths)]
    intervals += [("r0", 100, 100, "point"), ("r0", 100, 100, "point"), ("r0", 200, 100, "backwards"), ("r0", None, 100, "open"), ("r1", 5, None, "open"), (None, 0, 10, "nowhere"), ("r2", -(10**9), 10**6, "all")]
    return points, intervals


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("widest", [1 << 16, 64, 1])
def test_brute_force(spark, data, how, first, widest):
    points, intervals = data
    if widest == 1:
        intervals = [i for i in intervals if i[3] != "all"]
    got = ranges.join(spark.createDataFrame(points, P).repartition(3), spark.createDataFrame(intervals, I), ["rec"], "at", "lo", "hi", how, first, widest=widest)
    assert sorted(map(tuple, got.select("rec", "at", "tag", "lo", "hi", "name").collect()), key=str) == brute(points, intervals, how, first)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing(spark, data):
    points, intervals = spark.createDataFrame(data[0], P), spark.createDataFrame(data[1], I)
    assert ranges.join(points, intervals.limit(0), ["rec"], "at", "lo", "hi").count() == 0
    assert ranges.join(points, intervals.limit(0), ["rec"], "at", "lo", "hi", "left").count() == len(data[0])
    assert ranges.join(points.limit(0), intervals, ["rec"], "at", "lo", "hi", "left", True).count() == 0
    with pytest.raises(ValueError):
        ranges.join(points, intervals.withColumnRenamed("name", "tag"), ["rec"], "at", "lo", "hi")
