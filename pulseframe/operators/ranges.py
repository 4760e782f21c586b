"""Joins of points with intervals of any lengths: annotations, segments, windows.

An interval is filed under buckets of the power of two at or above its length,
of which it touches two at most; one longer than ``widest`` samples is filed
under all buckets of ``widest`` that it touches, so no key stands for more of a
recording than that.  A point asks one bucket of every size in use, some 17 at
most.  That makes the join an equi-join on recording, size and bucket, whose
keys hold no more of a hot recording than of any other; a point and an interval
meet once.

Defined cases.  Bounds are whole numbers and both belong to the interval; one
with a NULL bound, or that ends before it begins, holds nothing; NULL keys match
nothing.  Equal points and equal intervals are rows of their own.  ``first``
takes, of the intervals that hold a point, the least by ``order`` (by default
where they begin, then where they end); of such as are equal in that, the least
by all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, low: str, high: str, how: str = "inner", first: bool = False, order: list[str] | None = None, widest: int = 1 << 16) -> DataFrame:
    """Columns of ``points``, and those of ``intervals`` but ``on``; ``how`` is ``inner`` or ``left``, which keeps points that no interval holds."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    mine, theirs = list(points.columns), [c for c in intervals.columns if c not in on]
    both = set(mine) & set(theirs)
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    top = widest.bit_length() - 1
    lo, hi = F.col(low).cast("long"), F.col(high).cast("long")
    sized = intervals.filter(lo <= hi).withColumn("__size", F.least(F.lit(top), F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int")))
    sizes = [r[0] for r in sized.select("__size").distinct().collect()]  # top + 1 at most
    width = F.expr("shiftleft(1L, __size)")
    filed = sized.withColumn("__bucket", F.explode(F.sequence(lo - F.pmod(lo, width), hi, width)))
    filed = filed.select(*(F.col(c).alias(f"__{c}") for c in on), "__size", F.col("__bucket"), F.struct(*theirs).alias("__own"))
    asked = points.withColumn("__id", F.monotonically_increasing_id()).withColumn("__ask", F.explode_outer(F.array(*(F.lit(s) for s in sorted(sizes))).cast("array<int>")))
    place = F.col(at).cast("long")
    asked = asked.withColumn("__from", place - F.pmod(place, F.expr("shiftleft(1L, __ask)")))
    key = [F.col(c) == F.col(f"__{c}") for c in on] + [F.col("__ask") == F.col("__size"), F.col("__from") == F.col("__bucket")]
    inside = (F.col(f"__own.{low}") <= place) & (F.col(f"__own.{high}") >= place)
    if how == "inner" and not first:
        return asked.join(filed, [*key, inside]).select(*mine, *(F.col(f"__own.{c}").alias(c) for c in theirs))
    met = asked.join(filed, [*key, inside], how)
    rest = [c for c in theirs if c not in (order or [low, high])]
    ranked = F.struct(*(F.col(f"__own.{c}").alias(c) for c in [*(order or [low, high]), *rest]))
    found = F.when(F.col("__own").isNotNull(), ranked)
    # a point has a row for every size it asked: those of a point come together again, few of them
    grouped = met.groupBy("__id").agg(F.first(F.struct(*mine)).alias("__point"), (F.array(F.min(found)) if first else F.collect_list(found)).alias("__found"))
    spread = grouped.select("__point", F.explode_outer("__found").alias("__f") if how == "left" else F.explode("__found").alias("__f"))
    if how == "inner":
        spread = spread.filter("__f IS NOT NULL")
    return spread.select(*(F.col(f"__point.{c}").alias(c) for c in mine), *(F.col(f"__f.{c}").alias(c) for c in theirs))

