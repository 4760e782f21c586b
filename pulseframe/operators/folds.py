"""Scans whose state feeds back: change points with reset, adaptive thresholds, streaming alarms.

The samples never enter the fold: windows first reduce them to segments,
candidates or intervals, of which a recording has a few hundred; those are
gathered per recording and folded by a higher-order function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cusum(series: DataFrame, threshold: float = 4.0, drift: float = 0.5) -> DataFrame:
    """Two-sided CUSUM of the z-scores of ``series(recording_id, k, x)``; both sums restart after a change point."""
    zs = series.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("xs"), F.avg("x").alias("mu"), (F.stddev_pop("x") + 1e-9).alias("sigma"))
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast("array<bigint>").alias("found"))

    def step(acc, e):
        z = (e["x"] - F.col("mu")) / F.col("sigma")
        up, down = F.greatest(F.lit(0.0), acc["up"] + z - drift), F.greatest(F.lit(0.0), acc["down"] - z - drift)
        hit = (up > threshold) | (down > threshold)
        return F.struct(F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"), F.when(hit, F.concat(acc["found"], F.array(e["k"].cast("long")))).otherwise(acc["found"]).alias("found"))

    found = F.when(F.size("xs") >= 4, F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), start, step, lambda a: a["found"])).otherwise(F.array().cast("array<bigint>"))
    return zs.select("recording_id", F.size("xs").cast("long").alias("segments"), F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("change_points"))


CUSUM_DUCKDB = """
SELECT recording_id, n AS segments, CASE WHEN n < 4 THEN '' ELSE array_to_string(list_transform(list_reduce(list_transform(xs[2:], lambda e: {'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'found': []::BIGINT[], 'k': e.k::BIGINT, 'z': ((e.x - mu) / sigma)::DOUBLE}),
  lambda a, e: CASE WHEN greatest(0.0, a.up + e.z - {drift}) > {threshold} OR greatest(0.0, a.down - e.z - {drift}) > {threshold} THEN {'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'found': list_append(a.found, e.k), 'k': e.k, 'z': e.z}
               ELSE {'up': greatest(0.0, a.up + e.z - {drift})::DOUBLE, 'down': greatest(0.0, a.down - e.z - {drift})::DOUBLE, 'found': a.found, 'k': e.k, 'z': e.z} END,
  {'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'found': []::BIGINT[], 'k': 0::BIGINT, 'z': 0.0::DOUBLE}).found, lambda k: k::VARCHAR), ',') END AS change_points
FROM (SELECT recording_id, count(*) AS n, list({'k': k, 'x': x} ORDER BY k) AS xs, avg(x) AS mu, stddev_pop(x) + 1e-9 AS sigma FROM {series} AS s GROUP BY recording_id) AS t
"""


def cusum_oracle(series: str, threshold: float = 4.0, drift: float = 0.5) -> str:
    return CUSUM_DUCKDB.replace("{drift}", str(drift)).replace("{threshold}", str(threshold)).replace("{series}", f"({series})")


def adaptive_threshold(candidates: DataFrame, refractory: int, alpha: float = 0.125) -> DataFrame:
    """Signal and noise levels follow ``candidates(recording_id, idx, w)``; one is accepted above a quarter of the way between them, outside the refractory time."""
    xs = candidates.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("xs"), F.max("w").alias("top"))
    start = F.struct((0.5 * F.col("top")).alias("s"), (0.05 * F.col("top")).alias("n"), F.lit(-(10**9)).cast("long").alias("last"), F.lit(0).cast("long").alias("count"))

    def step(a, e):
        over = (e["w"] > a["n"] + 0.25 * (a["s"] - a["n"])) & (e["idx"] - a["last"] >= refractory)
        return F.struct(
            F.when(over, alpha * e["w"] + (1 - alpha) * a["s"]).otherwise(a["s"]).alias("s"),
            F.when(over, a["n"]).otherwise(alpha * e["w"] + (1 - alpha) * a["n"]).alias("n"),
            F.when(over, e["idx"].cast("long")).otherwise(a["last"]).alias("last"),
            (a["count"] + F.when(over, 1).otherwise(0)).alias("count"),
        )

    out = xs.select("recording_id", F.size("xs").cast("long").alias("candidates"), F.aggregate("xs", start, step).alias("a"))
    return out.select("recording_id", "candidates", F.col("a.count").alias("accepted"), F.round("a.s", 3).alias("spki"), F.round("a.n", 3).alias("npki"), F.col("a.last").alias("last_peak"))


ADAPTIVE_DUCKDB = """
SELECT recording_id, n AS candidates, a.count AS accepted, round(a.s, 3) AS spki, round(a.n, 3) AS npki, a.last AS last_peak
FROM (SELECT recording_id, n, list_reduce(list_transform(xs, lambda e: {'s': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 'last': e.idx::BIGINT, 'count': 0::BIGINT, 'w': e.w::DOUBLE}),
  lambda a, e: CASE WHEN e.w > a.n + 0.25 * (a.s - a.n) AND e.last - a.last >= {refractory} THEN {'s': ({alpha} * e.w + (1 - {alpha}) * a.s)::DOUBLE, 'n': a.n, 'last': e.last, 'count': (a.count + 1)::BIGINT, 'w': e.w}
               ELSE {'s': a.s, 'n': ({alpha} * e.w + (1 - {alpha}) * a.n)::DOUBLE, 'last': a.last, 'count': a.count, 'w': e.w} END,
  {'s': (0.5 * top)::DOUBLE, 'n': (0.05 * top)::DOUBLE, 'last': (-1000000000)::BIGINT, 'count': 0::BIGINT, 'w': 0.0::DOUBLE}) AS a
 FROM (SELECT recording_id, count(*) AS n, max(w) AS top, list({'idx': idx, 'w': w} ORDER BY idx) AS xs FROM {c} AS c GROUP BY recording_id) AS t) AS u
"""


def adaptive_oracle(candidates: str, refractory: int, alpha: float = 0.125) -> str:
    return ADAPTIVE_DUCKDB.replace("{refractory}", str(refractory)).replace("{alpha}", str(alpha)).replace("{c}", f"({candidates})")


def streaming_vt(intervals: DataFrame, bpm: float = 120.0, beats: int = 4) -> DataFrame:
    """Alarms of the beat-by-beat rule over ``intervals(recording_id, k, rr)``: so many rapid beats on end, armed again by a slow one."""
    xs = intervals.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("k", "rr"))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(False).alias("active"), F.lit(0).cast("long").alias("alarms"), F.lit(None).cast("double").alias("latency"))

    def step(a, e):
        rapid = 60 / e["rr"] >= bpm
        run = F.when(rapid, a["run"] + 1).otherwise(0)
        fire = rapid & ~a["active"] & (run >= beats)
        return F.struct(run.cast("long").alias("run"), F.when(rapid, a["active"] | fire).otherwise(False).alias("active"), (a["alarms"] + F.when(fire, 1).otherwise(0)).cast("long").alias("alarms"), F.coalesce(a["latency"], F.when(fire, e["rr"] * run)).alias("latency"))

    return xs.select("recording_id", F.aggregate("xs", start, step).alias("a")).select("recording_id", F.col("a.alarms").alias("alarms"), F.col("a.active").alias("active"), F.round("a.latency", 6).alias("first_latency_s"))


STREAMING_DUCKDB = """
SELECT recording_id, a.alarms AS alarms, a.active AS active, round(a.latency, 6) AS first_latency_s
FROM (SELECT recording_id, list_reduce(list_transform(xs, lambda e: {'run': 0::BIGINT, 'active': false, 'alarms': 0::BIGINT, 'latency': NULL::DOUBLE, 'rr': e.rr::DOUBLE}),
  lambda a, e: {'run': (CASE WHEN 60 / e.rr >= {bpm} THEN a.run + 1 ELSE 0 END)::BIGINT, 'active': 60 / e.rr >= {bpm} AND (a.active OR a.run + 1 >= {beats}),
                'alarms': (a.alarms + CASE WHEN 60 / e.rr >= {bpm} AND NOT a.active AND a.run + 1 >= {beats} THEN 1 ELSE 0 END)::BIGINT,
                'latency': coalesce(a.latency, CASE WHEN 60 / e.rr >= {bpm} AND NOT a.active AND a.run + 1 >= {beats} THEN e.rr * (a.run + 1) END)::DOUBLE, 'rr': e.rr},
  {'run': 0::BIGINT, 'active': false, 'alarms': 0::BIGINT, 'latency': NULL::DOUBLE, 'rr': 1.0::DOUBLE}) AS a
 FROM (SELECT recording_id, list({'k': k, 'rr': rr} ORDER BY k) AS xs FROM {i} AS i GROUP BY recording_id) AS t) AS u
"""


def streaming_vt_oracle(intervals: str, bpm: float = 120.0, beats: int = 4) -> str:
    return STREAMING_DUCKDB.replace("{bpm}", str(bpm)).replace("{beats}", str(beats)).replace("{i}", f"({intervals})")
