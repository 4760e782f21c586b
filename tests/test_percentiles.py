"""Percentiles by counting against Spark's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import percentiles

PS = [0.0, 0.01, 0.05, 0.5, 0.95, 0.999, 1.0]


def both(df, groups, ps=PS, **options):
    want = df.groupBy(*groups).agg(F.percentile("v", ps).alias("percentiles")).filter("percentiles IS NOT NULL")
    return sorted(map(str, percentiles.exact(df, groups, "v", ps, **options).collect())), sorted(map(str, want.collect()))


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(9)
    kinds = {"normal": r.normal(size=3000), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "equal": np.full(500, 7.25), "ties": r.integers(0, 4, 2000).astype(float), "tail": np.exp(6 * r.normal(size=1500)), "outlier": np.append(r.normal(size=800), [1e300, -1e300, 1.7e308, -1.7e308]), "close": 1 + r.integers(0, 50, 700) * 2.0**-52, "zeros": np.array([0.0, -0.0] * 40 + [1.0])}
    rows = [(k, i % 2, float(v)) for k, x in kinds.items() for i, v in enumerate(x)] + [("empty", 0, None), ("normal", 0, None), (None, 1, 4.0), (None, 1, 5.5)]
    return spark.createDataFrame(rows, "name string, part int, v double").repartition(5)


@pytest.mark.parametrize("options", [{}, {"few": 5, "bins": 256}, {"few": 100, "bins": 64, "broadcast_rows": 0}])
def test_equal_to_percentile(table, options):
    got, want = both(table, ["name", "part"], **options)
    assert [g.replace("-0.0", "0.0") for g in got] == [w.replace("-0.0", "0.0") for w in want]


def test_one_group_and_nothing(table):
    got, want = both(table.filter("name <> 'outlier'"), [], few=30)
    assert got == want
    assert percentiles.exact(table.limit(0), ["name"], "v", PS).count() == 0


def test_a_large_group_is_never_together(spark):
    """No task gets more rows of a group than bins: the plan sums before it exchanges, and only few values are listed."""
    df = spark.range(0, 2_000_000, 1, 8).selectExpr("'a' AS g", "sin(id) * 1000 + (id % 7) AS v")
    got = percentiles.exact(df, ["g"], "v", [0.05, 0.5, 0.95]).first().percentiles
    assert got == df.agg(F.percentile("v", [0.05, 0.5, 0.95])).first()[0]
