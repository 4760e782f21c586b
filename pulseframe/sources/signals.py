"""Signals in long form - ``recording_id, idx, v`` - from the tables at hand.

``v`` is NULL where a sample is missing; NaN and infinities become NULL on the
way in, since both sort above all numbers in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "SELECT event_type AS recording_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS v FROM {events}"
GAPS = "SELECT event_type AS recording_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM {events}"
#: The same as ``EVENTS`` and ``GAPS``, numbered by day in parallel: a day's samples are numbered among themselves, after those of all days before.
SPLIT = """
SELECT recording_id, CAST(before + row_number() OVER (PARTITION BY recording_id, day ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, {value} AS v
FROM (SELECT event_type AS recording_id, CAST(ts AS DATE) AS day, ts, event_id, value FROM {events}) AS s0
JOIN (SELECT recording_id AS s1, day AS s2, sum(n) OVER (PARTITION BY recording_id ORDER BY day) - n AS before
      FROM (SELECT event_type AS recording_id, CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY event_type, CAST(ts AS DATE)) AS s3) AS s4 ON recording_id = s1 AND day = s2
"""
EVENTS_SPLIT, GAPS_SPLIT = SPLIT.replace("{value}", "value"), SPLIT.replace("{value}", "CASE WHEN event_id % 17 <> 0 THEN value END")
LINEITEM = "SELECT CAST(l_suppkey AS STRING) AS recording_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx, l_extendedprice AS v FROM {lineitem}"

#: The same with recordings of a few samples, an order each.
ORDERS = f"SELECT concat('o', CAST(l_orderkey AS STRING)) AS recording_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS idx, l_extendedprice AS v FROM {{lineitem}} UNION ALL {LINEITEM}"

#: Closed-form recordings: one for each nation, 3,000 samples at 360 Hz, bell-shaped beats at 50 to 170 bpm, baseline wander and, for odd keys, a 50 Hz tone.
SYNTH = """
SELECT recording_id, idx, exp(-pow((idx - beat * period) / 9.0, 2)) * (1 + 0.1 * (beat % 3)) + 0.15 * exp(-pow((idx - beat * period - 90) / 25.0, 2))
       + 0.05 * sin(idx * 0.0035) + tone * 0.02 * sin(idx * 0.872664625997165) AS v, period, beat
FROM (SELECT recording_id, idx, period, tone, CAST(floor((idx + period / 2.0) / period) AS BIGINT) AS beat
      FROM (SELECT n_name AS recording_id, CAST(round(360 * 60.0 / (50 + 5 * n_nationkey)) AS BIGINT) AS period, n_nationkey % 2 AS tone, x AS idx
            FROM {nation}, SEQ(0, 2999, u, x)) AS a) AS b
"""


#: A number between -3 and 3 for every sample, of mean 0 and variance 1, that looks like noise and is the same wherever it is computed.
NOISE = "(2.0 * (" + " + ".join(f"((idx * idx * {a} + idx * {b} + 17) % 1000003) / 1000003" for a, b in ((7919, 104729), (15485, 32452), (98765, 1299))) + " - 1.5))"

#: A minute of a sine of 1.2 Hz with a little noise for each region, to time the engine with; no beats.
SINE = f"SELECT recording_id, idx, sin({2 * 3.141592653589793 * 1.2 / 360.0} * idx) + 0.05 * {NOISE} AS v FROM (SELECT r_name AS recording_id, x AS idx FROM {{region}}, SEQ(0, 21599, u, x)) AS b"

#: Pulse waves at 100 Hz, one recording a region: a systolic hump and a lesser, later one for each pulse.
PULSES = """
SELECT recording_id, idx, exp(-pow((idx - beat * period - 15) / 8.0, 2)) + 0.35 * exp(-pow((idx - beat * period - 40) / 12.0, 2)) AS v, period
FROM (SELECT recording_id, idx, period, CAST(floor(idx / (period * 1.0)) AS BIGINT) AS beat
      FROM (SELECT r_name AS recording_id, CAST(round(100 * 60.0 / (55 + 10 * r_regionkey)) AS BIGINT) AS period, x AS idx FROM {region}, SEQ(0, 1999, u, x)) AS a) AS b
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_arrays(df: DataFrame, array_col: str, id_col: str) -> DataFrame:
    """An array of samples per row, as long rows; what isn't finite becomes NULL."""
    out = df.select(F.col(id_col).cast("string").alias("recording_id"), F.posexplode_outer(array_col).alias("idx", "v"))
    return normalize(out.withColumn("idx", F.col("idx").cast("long")).withColumn("v", F.col("v").cast("double")))


def normalize(signal: DataFrame) -> DataFrame:
    """NaN and infinities to NULL."""
    v = F.col("v")
    return signal.withColumn("v", F.when(~(F.isnan(v) | (F.abs(v) == float("inf"))), v))


def validate(signal: DataFrame, recordings: DataFrame, fs_min: float = 50.0, fs_max: float = 10_000.0, min_samples: int = 100, min_duration_s: float = 2.0) -> DataFrame:
    """``recording_id, valid, message``: a bad recording is a row that says so, not a failed job."""
    facts = signal.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("finite"))
    fs, n = F.col("fs"), F.coalesce(F.col("n"), F.lit(0))
    message = (
        F.when(fs.isNull() | F.isnan(fs), "sampling rate is missing")
        .when((fs < fs_min) | (fs > fs_max), F.format_string("sampling rate %.1f Hz is outside %.0f to %.0f Hz", fs, F.lit(fs_min), F.lit(fs_max)))
        .when(n < min_samples, F.format_string("too short: %d samples, at least %d are needed", n, F.lit(min_samples)))
        .when(n / fs < min_duration_s, F.format_string("too short: %.2f s, at least %.1f s are needed", n / fs, F.lit(min_duration_s)))
        .when(F.coalesce(F.col("finite"), F.lit(0)) == 0, "no finite sample")
    )
    return recordings.join(facts, "recording_id", "left").select("recording_id", message.isNull().alias("valid"), F.coalesce(message, F.lit("OK")).alias("message"))
