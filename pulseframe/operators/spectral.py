"""Spectra in relational form: a discrete Fourier transform by join, and what is read off it.

Welch's method with half-overlapping, mean-free segments under a periodic Hann
window.  ``psd`` joins samples with bins, which is meant for short segments;
``welch`` takes two stages, as in a mixed-radix fast transform, for those of 256 to 2,048 samples.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from . import _sql

#: Samples of a partition of long spectra: both stages hold some 16 sums a sample, about 1 KB.
SPREAD = 100_000


def psd(fs: float = 360.0, nperseg: int = 64) -> str:
    step = nperseg // 2
    norm = fs * sum((0.5 - 0.5 * math.cos(2 * math.pi * i / nperseg)) ** 2 for i in range(nperseg))
    return f"""
SELECT recording_id, bin, bin * {fs / nperseg} AS freq, avg((re * re + im * im) / {norm} * CASE WHEN bin = 0 OR bin = {nperseg // 2} THEN 1 ELSE 2 END) AS p
FROM (SELECT recording_id, seg, bin, sum(x * cos({2 * math.pi / nperseg} * bin * i)) AS re, sum(x * sin({2 * math.pi / nperseg} * bin * i)) AS im
      FROM (SELECT recording_id, seg, i, (v - avg(v) OVER (PARTITION BY recording_id, seg)) * (0.5 - 0.5 * cos({2 * math.pi / nperseg} * i)) AS x
            FROM (SELECT recording_id, seg, idx - seg * {step} AS i, v, count(*) OVER (PARTITION BY recording_id, seg) AS full_
                  FROM (SELECT recording_id, idx, v, CAST(floor(idx / {step}) AS BIGINT) - o AS seg FROM {{s}} AS a, SEQ(0, 1, u, o)) AS b WHERE seg >= 0) AS c
            WHERE full_ = {nperseg}) AS d, SEQ(0, {nperseg // 2}, w, bin)
      GROUP BY recording_id, seg, bin) AS e
GROUP BY recording_id, bin
"""


def dft_power(fs: float = 360.0, nperseg: int = 64) -> str:
    return f"SELECT recording_id, bin, round(freq, 6) AS freq, round(p, 6) AS power, round(10 * log10(p + 1e-5), 2) AS db FROM ({psd(fs, nperseg)}) AS f"


def band_fraction(fs: float = 360.0, nperseg: int = 64) -> str:
    """Shares of power above 100 Hz and below 1 Hz, with the severities they stand for."""
    return f"""
SELECT recording_id, round(hf, 6) AS hf_fraction, CASE WHEN hf >= 0.35 THEN 'SEVERE EMG' WHEN hf >= 0.15 THEN 'MODERATE EMG' WHEN hf >= 0.05 THEN 'MILD EMG' ELSE 'CLEAN' END AS emg_severity, round(lf, 6) AS lf_fraction, CASE WHEN lf > 0.40 THEN 'severe' WHEN lf > 0.15 THEN 'moderate' ELSE 'none' END AS drift
FROM (SELECT recording_id, sum(CASE WHEN freq > 100 THEN p ELSE 0 END) / NULLIF(sum(p), 0) AS hf, sum(CASE WHEN freq < 1 THEN p ELSE 0 END) / NULLIF(sum(p), 0) AS lf FROM ({psd(fs, nperseg)}) AS f GROUP BY recording_id) AS g
"""


def spectral_entropy(fs: float = 360.0, nperseg: int = 64) -> str:
    return f"SELECT recording_id, round(least(1.0, greatest(0.0, -sum(q * log2(q)) / log2({nperseg // 2 + 1}))), 6) AS entropy FROM (SELECT recording_id, p / sum(p) OVER (PARTITION BY recording_id) AS q FROM ({psd(fs, nperseg)}) AS f) AS g WHERE q > 0 GROUP BY recording_id"


def powerline(fs: float = 360.0, nperseg: int = 64, freq: float = 50.0) -> str:
    """Power at the bin nearest to ``freq`` over the median of the bins more than five away."""
    k = min(range(nperseg // 2 + 1), key=lambda b: (abs(b * fs / nperseg - freq), b))
    return f"""
SELECT recording_id, round(10 * log10((peak + 1e-5) / (floor_ + 1e-5)), 2) AS over_floor_db, 10 * log10((peak + 1e-5) / (floor_ + 1e-5)) > 10 AS powerline
FROM (SELECT recording_id, max(CASE WHEN bin = {k} THEN p END) AS peak, MEDIAN(CASE WHEN bin NOT BETWEEN {k - 5} AND {k + 5} THEN p END) AS floor_ FROM ({psd(fs, nperseg)}) AS f GROUP BY recording_id) AS g
"""


# Readings of a Welch spectrum ``f(recording_id, k, freq, p)`` of any segment length, one row a bin.

MUSCLE_BAND = """
SELECT recording_id, round(hf, 6) AS hf_fraction, CASE WHEN hf >= 0.35 THEN 'SEVERE EMG' WHEN hf >= 0.15 THEN 'MODERATE EMG' WHEN hf >= 0.05 THEN 'MILD EMG' ELSE 'CLEAN' END AS emg_severity
FROM (SELECT recording_id, sum(CASE WHEN freq > 100 THEN p ELSE 0 END) / (sum(p) + 1e-30) AS hf FROM {f} AS a GROUP BY recording_id) AS b
"""

DRIFT_BAND = """
SELECT recording_id, round(lf, 6) AS lf_fraction, CASE WHEN lf > 0.40 THEN 'Baseline wander' WHEN lf > 0.15 THEN 'Mild baseline wander' ELSE 'Clean' END AS noise_type, CASE WHEN lf > 0.35 THEN 'severe' WHEN lf > 0.10 THEN 'moderate' ELSE 'none' END AS drift_level
FROM (SELECT recording_id, sum(CASE WHEN freq < 1 THEN p ELSE 0 END) / (sum(p) + 1e-30) AS lf FROM {f} AS a GROUP BY recording_id) AS b
"""


#: Whether the bin nearest to a mains frequency (50 and 60 Hz) stands over 10 dB above the median of all bins more than five away from it.
MAINS = """
SELECT recording_id, mains_hz, round(db, 2) AS over_floor_db, db > 10 AS powerline
FROM (SELECT recording_id, mains_hz, 10 * log10(greatest(max(CASE WHEN k = centre THEN p END), 1e-30) / (MEDIAN(CASE WHEN k NOT BETWEEN centre - 5 AND centre + 5 THEN p END) + 1e-30)) AS db
      FROM (SELECT recording_id, k, p, mains_hz, first_value(k) OVER (PARTITION BY recording_id, mains_hz ORDER BY abs(freq - mains_hz), k) AS centre
            FROM (SELECT recording_id, k, freq, p, 50 + 10 * j AS mains_hz FROM {f} AS a, SEQ(0, 1, u, j)) AS b) AS c
      GROUP BY recording_id, mains_hz) AS d
"""


def welch(fs: float = 360.0, nperseg: int = 256, parts: int | None = None) -> str:
    """``recording_id, k, freq, p`` of segments of ``nperseg`` samples, a power of two; a shorter recording is one segment.

    A segment of ``l = a * b`` samples is read as ``b`` columns of every ``b``-th
    sample.  The first stage transforms each column (``a`` products a sample), each
    result is turned by its twiddle factor, the second stage transforms across the
    columns: ``a + b / 2`` products a sample instead of ``l / 2``, 48 for 1,024.
    Both stages are aggregates by segment and bin, so long recordings spread over
    their segments, over ``parts`` partitions if that is given. A recording shorter than a segment has columns of one sample; of a single sample the power is NULL.
    """
    a = 1 << ((nperseg.bit_length() - 1) // 2)
    turn = "2 * pi() * {} / {}"
    near, far = turn.format("((i DIV b) * c % a)", "a"), turn.format("(r * d % b)", "b")
    twiddle = turn.format("(r * c % l)", "l")
    deal = f"/*+ REPARTITION({parts}, recording_id, seg) */ " if parts else ""
    return f"""
SELECT recording_id, k, k * {fs} / l AS freq, avg((re * re + im * im) / ({fs} * NULLIF(power, 0))) * CASE WHEN k = 0 OR 2 * k = l THEN 1 ELSE 2 END AS p
FROM (SELECT recording_id, seg, l, power, c + a * d AS k, sum(tr * cos({far}) + ti * sin({far})) AS re, sum(ti * cos({far}) - tr * sin({far})) AS im
      FROM (SELECT recording_id, seg, l, power, a, b, r, c, re * cos({twiddle}) + im * sin({twiddle}) AS tr, im * cos({twiddle}) - re * sin({twiddle}) AS ti
            FROM (SELECT recording_id, seg, l, power, a, b, i % b AS r, c, sum(y * cos({near})) AS re, -sum(y * sin({near})) AS im
                  FROM (SELECT recording_id, seg, l, a, b, i, (v - avg(v) OVER (PARTITION BY recording_id, seg)) * w AS y, sum(w * w) OVER (PARTITION BY recording_id, seg) AS power
                        FROM (SELECT {deal}recording_id, seg, l, CASE WHEN l = {nperseg} THEN {a} ELSE 1 END AS a, CASE WHEN l = {nperseg} THEN {nperseg // a} ELSE l END AS b, idx - seg * hop AS i, v, 0.5 - 0.5 * cos(2 * pi() * (idx - seg * hop) / l) AS w
                              FROM (SELECT recording_id, idx, v, n, l, hop, (idx DIV hop) - o AS seg
                                    FROM (SELECT recording_id, idx, v, n, l, l - (l DIV 2) AS hop FROM {{s}} AS t0 JOIN (SELECT recording_id AS r0, count(*) AS n, least({nperseg}, count(*)) AS l FROM {{s}} AS t1 GROUP BY recording_id) AS t2 ON recording_id = r0) AS t3, SEQ(0, 1, u0, o)) AS t4
                              WHERE seg >= 0 AND seg * hop <= n - l AND idx - seg * hop < l) AS t5) AS t6, SEQ(0, a - 1, u1, c)
                  GROUP BY recording_id, seg, l, power, a, b, i % b, c) AS t7) AS t8, SEQ(0, (l DIV 2 - c) DIV a, u2, d)
      WHERE 2 * c <= l
      GROUP BY recording_id, seg, l, power, c + a * d) AS t9
GROUP BY recording_id, k, l
"""


def spread(signal: DataFrame, fs: float = 360.0, nperseg: int = 256, each: int = SPREAD) -> DataFrame:
    """``welch`` over a signal of any size: a partition has segments of some ``each`` samples, which bounds what a task holds.

    The number of partitions is stated, because adaptive execution would join
    small ones before the stages multiply their rows.
    """
    parts = max(signal.sparkSession.sparkContext.defaultParallelism, -(-signal.count() // each))
    return _sql.run(welch(fs, nperseg, parts), s=signal)


def low_share(group: str = "0", fs: float = 360.0, nperseg: int = 256, below: float = 1.0) -> str:
    """Share of Welch's power below a frequency for every ``group`` of a recording, without a transform.

    The whole power is the energy of the windowed samples (Parseval), so only the
    few low bins are summed: a sample costs two rows, whatever the length. What
    is missing is taken out first; groups under 32 samples have a share of 0.
    """
    bins = [k for k in range(1, nperseg // 2 + 1) if k * fs < below * nperseg]
    wave = "2 * pi() * {k} * i / l"
    low = " + ".join(["sum(y) * sum(y)"] + [f"CASE WHEN {k} * {fs} < {below} * max(l) AND {2 * k} <= max(l) THEN CASE WHEN {2 * k} = max(l) THEN 1 ELSE 2 END * (power(sum(y * cos({wave.format(k=k)})), 2) + power(sum(y * sin({wave.format(k=k)})), 2)) ELSE 0 END" for k in bins])
    return f"""
SELECT recording_id, grp, CASE WHEN max(m) < 32 OR avg(energy) * {8 / (3 * fs)!r} < 1e-20 THEN 0.0 ELSE least(1.0, greatest(0.0, sum(low) / sum(l * energy))) END AS low
FROM (SELECT recording_id, grp, seg, max(m) AS m, max(l) AS l, sum(y * y) AS energy, {low} AS low
      FROM (SELECT recording_id, grp, seg, m, l, i, (v - avg(v) OVER (PARTITION BY recording_id, grp, seg)) * (0.5 - 0.5 * cos(2 * pi() * i / l)) AS y
            FROM (SELECT recording_id, grp, m, l, hop, v, place, seg, place - seg * hop AS i
                  FROM (SELECT recording_id, grp, m, l, hop, v, place, CAST(floor(place / hop) AS BIGINT) - o AS seg
                        FROM (SELECT *, l - CAST(floor(l / 2) AS BIGINT) AS hop
                              FROM (SELECT *, least({nperseg}, m) AS l
                                    FROM (SELECT recording_id, grp, v, row_number() OVER (PARTITION BY recording_id, grp ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY recording_id, grp) AS m
                                          FROM (SELECT recording_id, idx, v, {group} AS grp FROM {{s}} AS la WHERE v IS NOT NULL) AS lb) AS lc) AS ld) AS le, SEQ(0, 1, lu, o)) AS lf
                  WHERE seg >= 0 AND seg * hop <= m - l) AS lg
            WHERE i < l) AS lh
      GROUP BY recording_id, grp, seg) AS li
GROUP BY recording_id, grp
"""
