"""Exact percentiles of groups of any size, by counting.

Spark's ``percentile`` keeps every value of a group in one task.  Here each
round counts all rows in a few hundred bins of each range that is still open, with
the bins' least and greatest values, and goes on with the bins that hold the
wanted ranks; a range ends when its values are equal, or so few that they can
be sorted together.  A round is one aggregation with partial sums, so a group
costs a task ``bins`` rows whatever its size.  Bins are equal steps between the least and
the greatest value that are really there, so far outliers cost a round, not
resolution.

Memory: ``few`` values a rank at the end; the driver learns how many ranges are
open.  Ranges are joined to rows by broadcast while there are at most
``broadcast_rows`` of them, by shuffle beyond.

Defined cases.  NULLs don't count; NaN and infinities aren't allowed (they are
NULL in this engine); a group without values has no row; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import settled


def exact(df: DataFrame, groups: list[str], value: str, ps: list[float], bins: int = 512, few: int = 4096, broadcast_rows: int = 50_000) -> DataFrame:
    """``groups`` and an array ``percentiles`` in the order of ``ps``, equal to ``percentile(value, ps)``."""
    keys = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    facts = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.explode(F.array(*(F.lit(float(p)) for p in sorted(set(ps)))))
    wanted = facts.select("*", place.alias("p")).withColumn("at", (F.col("n") - 1) * F.col("p"))
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    open_ = settled(wanted.select(*keys, "rank", F.lit(0).cast("long").alias("below"), "n", "lo", "hi").distinct())
    done = []
    while True:
        ended = open_.filter((F.col("lo") == F.col("hi")) | (F.col("n") <= few))
        done.append(ended)
        open_ = open_.filter((F.col("lo") < F.col("hi")) & (F.col("n") > few))
        count = open_.count()
        if not count:
            break
        ranges = open_.select(*keys, "lo", "hi").distinct()
        ranges = F.broadcast(ranges) if count <= broadcast_rows else ranges
        inside = rows.alias("r").join(ranges.alias("o"), [*same("r", "o"), F.col("r.v") >= F.col("o.lo"), F.col("r.v") <= F.col("o.hi")])
        # each of these steps keeps order, so bins do, too, rounding and all
        step = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        half = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))  # where the range itself is beyond doubles
        own = inside.select(*(F.col(f"r.{k}").alias(k) for k in keys), "lo", "hi", "v", F.when(F.col("hi") - F.col("lo") == float("inf"), half).otherwise(step).alias("bin"))
        counts = own.groupBy(*keys, "lo", "hi", "bin").agg(F.count("v").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("k").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin")) - F.col("k")  # over bins
        counts = counts.withColumn("before", before)
        met = open_.alias("o").join(counts.alias("c"), [*same("o", "c"), F.col("o.lo") == F.col("c.lo"), F.col("o.hi") == F.col("c.hi")])
        met = met.filter((F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("k")))
        open_ = settled(met.select(*(F.col(f"o.{k}").alias(k) for k in keys), "rank", (F.col("below") + F.col("before")).alias("below"), F.col("k").alias("n"), F.col("least").alias("lo"), F.col("most").alias("hi")))
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    ended = settled(ended)
    equal = ended.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
    small = ended.filter("lo < hi")
    ranges = small.select(*keys, "lo", "hi").distinct()
    ranges = F.broadcast(ranges) if small.count() <= broadcast_rows else ranges
    lists = rows.alias("r").join(ranges.alias("o"), [*same("r", "o"), F.col("r.v") >= F.col("o.lo"), F.col("r.v") <= F.col("o.hi")])
    lists = lists.groupBy(*(F.col(f"r.{k}").alias(k) for k in keys), "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("list"))  # ``few`` at most
    found = small.alias("s").join(lists.alias("l"), [*same("s", "l"), F.col("s.lo") == F.col("l.lo"), F.col("s.hi") == F.col("l.hi")])
    found = found.select(*(F.col(f"s.{k}").alias(k) for k in keys), "rank", F.element_at("list", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value"))
    ranked = equal.unionByName(found).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("values"))  # two a percentile
    out = []
    for p in ps:
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        a, b = F.element_at("values", low), F.element_at("values", high)
        out.append(F.when(a == b, a).otherwise((high - at) * a + (at - low) * b))
    joined = facts.select(*keys, "n").alias("f").join(ranked.alias("q"), same("f", "q")) if keys else facts.select("n").crossJoin(ranked)  # of one row each
    return joined.select(*(F.col(f"f.{k}").alias(g) for k, g in zip(keys, groups, strict=True)), F.array(*out).alias("percentiles"))
