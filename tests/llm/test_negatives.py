"""Hard negatives against a brute-force loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score int, block string, n int"


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute(rows, every, positives=5, wanted=3):
    live = [(i, whole(v), y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (ai, av, ay) in enumerate(live):
        if ai is None or ai % every:
            continue
        scored = [(sum(x * y for x, y in zip(av, bv)), bi, by) for b, (bi, bv, by) in enumerate(live) if b != a]
        for s, p, _ in sorted((x for x in scored if x[2] == ay), key=lambda x: rank(x[0], x[1]))[:positives]:
            far = sorted((x for x in scored if x[2] != ay and 50 * s <= 100 * x[0] <= 95 * s), key=lambda x: rank(x[0], x[1]))
            out += [(ai, p, k + 1, n, s, t) for k, (t, n, _) in enumerate(far[:wanted])]
    return out


def rows(df):
    return sorted(df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect(), key=repr)


def run(spark, data, every=5, **options):
    df = spark.createDataFrame([(i, v, y, 1, "x", 2) for i, v, y in data], SCHEMA)
    return negatives.mine(df, anchor=F.col("vec_id") % every == 0, **options)


@pytest.mark.parametrize("options", [{}, {"block": 7, "anchor_block": 3, "chunk": 2}, {"block": 40, "anchor_block": 1, "chunk": 64}])
def test_brute_force(spark, options):
    r = np.random.default_rng(3)
    data = [(int(i), [float(x) for x in r.normal(size=6)], int(r.choice([0, 0, 0, 1, 2, 777]))) for i in range(160)]
    data += [(i, [0.5, 0.5, 0.25, 0.0, 0.0, 0.0], i % 2) for i in range(160, 200)]  # ties
    assert rows(run(spark, data, **options)) == sorted(brute(data, 5), key=repr)


@pytest.mark.parametrize("groups", [1, 3])
def test_labels_share_groups(spark, monkeypatch, groups):
    """Many labels in few groups: tiles within a group hold negatives, too."""
    monkeypatch.setattr(negatives, "GROUPS", groups)
    r = np.random.default_rng(4)
    data = [(int(i), [float(x) for x in r.normal(size=4)], int(i) % 9) for i in range(120)]
    assert rows(run(spark, data, block=16, anchor_block=4, chunk=3)) == sorted(brute(data, 5), key=repr)


def test_odd_rows(spark):
    """Nulls, NaN, infinities, unequal lengths, an empty vector, repeated rows, rows without an id; extra columns of clashing names."""
    data = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (5, [1.0], 1), (6, [], 1), (10, None, 1), (15, [1.0, None], 1), (20, [math.nan, 1.0], 1), (25, [math.inf], 1), (30, [1.0, 0.5], None)]
    data += [(7, [0.9, 0.9], 2), (7, [0.9, 0.9], 2), (None, [0.9, 0.9], 2), (None, [0.6, 0.6, 3.0], 2), (8, [0.5, 0.6], 2), (9, [-1.0, -1.0], 2), (11, [], 2)]
    assert rows(run(spark, data, block=2, anchor_block=1, chunk=1)) == sorted(brute(data, 5), key=repr)


def test_wide_values(spark):
    data = [(i, [float(2 ** (i % 11 + 4)), float(-(3**i % 1000))], i % 2) for i in range(40)]
    assert rows(run(spark, data, chunk=1)) == sorted(brute(data, 5), key=repr)
    with pytest.raises(ValueError):
        run(spark, [(0, [1e30], 0), (1, [1e30], 1)])


def test_nothing(spark):
    assert rows(run(spark, [])) == [] == rows(run(spark, [(1, [1.0], 1), (2, [1.0], 2)]))
    assert rows(run(spark, [(0, [1.0], 1), (1, [1.0], 1)])) == []  # no other label


@pytest.mark.parametrize("groups", [1, 256])
def test_rounds_of_anchors(spark, monkeypatch, groups):
    """Anchors in rounds of a block, panels of a few rows, many copies."""
    monkeypatch.setattr(negatives, "GROUPS", groups)
    monkeypatch.setattr(negatives, "ROUND_BYTES", 1)
    monkeypatch.setattr(negatives, "PANEL_BYTES", 64)
    r = np.random.default_rng(5)
    data = [(int(i), [float(x) for x in r.normal(size=3)], int(i) % 3) for i in range(24)]
    data += [(100 + i, [0.5, 0.25, 0.0], i % 2) for i in range(20)]
    assert rows(run(spark, data, every=8)) == sorted(brute(data, 8), key=repr)


def test_shuffle_grows_as_rows_do(spark):
    def shuffled():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def cost(n):
        v = F.array(*(F.rand(k) - 0.5 for k in range(8)))
        before = shuffled()
        negatives.mine(spark.range(n).select(F.col("id").alias("vec_id"), v.alias("embedding"), (F.col("id") % 3).alias("label")), F.col("vec_id") % 5 == 0, block=64, anchor_block=64, chunk=4)
        return shuffled() - before

    assert 0 < cost(4000) < 6 * cost(1000)  # four times the rows; tiles would be sixteen times as many
