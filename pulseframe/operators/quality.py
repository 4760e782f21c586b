"""Signal quality: amplitudes, noise, SNR proxy, saturation, segments and their change points."""

from __future__ import annotations

from .spectral import low_share

LEVEL = "CASE WHEN {x} < {warn} THEN 'GOOD' WHEN {x} < {poor} THEN 'MODERATE' WHEN {x} < {worst} THEN 'POOR' ELSE 'CRITICAL' END"


def level(x: str, warn: float, poor: float) -> str:
    """The ladder of levels; nine decimals keep shares that stand on a rung there."""
    return LEVEL.format(x=f"round({x}, 9)", warn=warn, poor=poor, worst=round(3 * poor, 6))


#: Finite samples in order, with their backward difference: what is missing is taken out before differences are formed.
DIFFS = "SELECT recording_id, idx, v, v - lag(v) OVER (PARTITION BY recording_id ORDER BY idx) AS d FROM {s} AS a WHERE v IS NOT NULL"
FACTS = f"""
SELECT recording_id, count(*) AS n, stddev_pop(v) AS sd, PCT(v, 0.95) - PCT(v, 0.05) AS amp, stddev_pop(d) / sqrt(2.0) AS noise, KURT(d) AS kurt, avg(v) AS mean
FROM ({DIFFS}) AS b GROUP BY recording_id
"""
SNR = "CASE WHEN n < 20 OR noise < 1e-12 OR amp < 1e-9 THEN NULL ELSE least(60.0, greatest(-20.0, 20 * log10(amp / noise))) END"

ROBUST_AMPLITUDE = f"SELECT recording_id, n, round(amp, 6) AS amplitude FROM ({FACTS}) AS c"
NOISE_RMS = f"SELECT recording_id, round(noise, 6) AS noise_rms, round(kurt, 4) AS step_kurtosis, kurt > 10 AS motion FROM ({FACTS}) AS c"
#: Muscle noise where the rate leaves no band above 100 Hz: by the kurtosis of the steps, on the batch scale and on the stricter one for segments.
MUSCLE_STEPS = f"""
SELECT recording_id, round(ratio, 6) AS emg_ratio, CASE WHEN ratio >= 0.35 THEN 'SEVERE EMG' WHEN ratio >= 0.15 THEN 'MODERATE EMG' WHEN ratio >= 0.05 THEN 'MILD EMG' ELSE 'CLEAN' END AS emg_severity, CASE WHEN kurt > 20 THEN 'SEVERE EMG' WHEN kurt > 10 THEN 'MODERATE EMG' WHEN kurt > 5 THEN 'MILD EMG' ELSE 'CLEAN' END AS segment_severity
FROM (SELECT recording_id, kurt, least(1.0, greatest(0.0, kurt / 20)) AS ratio FROM ({FACTS}) AS c) AS d
"""
SNR_PROXY = f"SELECT recording_id, round({SNR}, 6) AS snr_db FROM ({FACTS}) AS c"
SIGNAL_QUALITY = f"""
SELECT recording_id, n, round(amp, 6) AS amplitude, round(noise, 6) AS noise_rms, round({SNR}, 6) AS snr_db, round(missing, 6) AS missing_fraction, round(score, 6) AS score,
       CASE WHEN score >= 0.75 THEN 'GOOD' WHEN score >= 0.5 THEN 'MODERATE' WHEN score >= 0.25 THEN 'POOR' ELSE 'CRITICAL' END AS quality
FROM (SELECT c.*, missing, CASE WHEN sd < 1e-4 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - least(3 * missing, 0.5) - least(2 * noise / NULLIF(amp, 0), 0.5))) END AS score
      FROM ({FACTS}) AS c JOIN (SELECT recording_id AS rid, 1 - count(v) / count(*) AS missing FROM {{s}} AS m GROUP BY recording_id) AS e ON c.recording_id = e.rid) AS f
"""

SATURATION = f"""
SELECT recording_id, round(frac, 6) AS saturation_fraction, {level('frac', 0.01, 0.05)} AS level, frac > 0.02 AS flagged
FROM (SELECT s.recording_id, CASE WHEN max(p99 - p1) < 1e-9 THEN 1.0 ELSE avg(CASE WHEN v >= p99 - 0.02 * (p99 - p1) OR v <= p1 + 0.02 * (p99 - p1) THEN 1.0 ELSE 0.0 END) END AS frac
      FROM {{s}} AS s JOIN (SELECT recording_id AS rid, PCT(v, 0.01) AS p1, PCT(v, 0.99) AS p99 FROM {{s}} AS q WHERE v IS NOT NULL GROUP BY recording_id) AS p ON s.recording_id = p.rid
      WHERE v IS NOT NULL GROUP BY s.recording_id) AS t
"""

FLATLINE = "SELECT recording_id, stddev_pop(v) < 1e-4 AS flatline, stddev_pop(v) < 1e-6 AS pulse_flatline FROM {s} AS a GROUP BY recording_id"

QUALITY_OVERALL = f"""
SELECT recording_id, round(score, 4) AS score, CASE WHEN score >= 0.75 THEN 'GOOD' WHEN score >= 0.5 THEN 'MODERATE' WHEN score >= 0.25 THEN 'POOR' ELSE 'CRITICAL' END AS overall, noise_level, drift_level, saturation_level, missing_level, qrs_level
FROM (SELECT *, CASE WHEN sd < 1e-4 THEN 0.0 ELSE 0.25 * ln_ + 0.15 * ld_ + 0.20 * ls_ + 0.15 * lm_ + 0.25 * lq_ END AS score
      FROM (SELECT *, {{points:noise_level}} AS ln_, {{points:drift_level}} AS ld_, {{points:saturation_level}} AS ls_, {{points:missing_level}} AS lm_, {{points:qrs_level}} AS lq_
            FROM (SELECT f.recording_id, sd, CASE WHEN amp < 1e-9 THEN 'CRITICAL' ELSE {level('noise / NULLIF(amp, 0)', 0.05, 0.2)} END AS noise_level, {level('coalesce(low, 0.0)', 0.1, 0.35)} AS drift_level, {level('frac', 0.01, 0.05)} AS saturation_level, {level('missing', 0.005, 0.05)} AS missing_level,
                         CASE WHEN snr > 15 THEN 'GOOD' WHEN snr > 8 THEN 'MODERATE' WHEN snr > 2 THEN 'POOR' ELSE 'CRITICAL' END AS qrs_level
                  FROM (SELECT *, CASE WHEN n < 10 THEN 0.0 WHEN noise < 1e-12 THEN 60.0 ELSE least(60.0, greatest(-20.0, 20 * log10(greatest(amp, 1e-12) / greatest(noise, 1e-12)))) END AS snr FROM ({FACTS}) AS c) AS f
                  JOIN (SELECT recording_id AS r1, saturation_fraction AS frac FROM ({SATURATION}) AS u) AS sa ON f.recording_id = r1
                  JOIN (SELECT recording_id AS r2, 1 - count(v) / count(*) AS missing FROM {{s}} AS m GROUP BY recording_id) AS mi ON f.recording_id = r2
                  LEFT JOIN (SELECT recording_id AS r3, low FROM ({low_share()}) AS dr) AS lo ON f.recording_id = r3) AS g) AS h) AS i
"""
for _name in ("noise_level", "drift_level", "saturation_level", "missing_level", "qrs_level"):
    QUALITY_OVERALL = QUALITY_OVERALL.replace(f"{{points:{_name}}}", f"CASE {_name} WHEN 'GOOD' THEN 1.0 WHEN 'MODERATE' THEN 0.65 WHEN 'POOR' THEN 0.35 ELSE 0.0 END")


# --- segments -----------------------------------------------------------------


def segments(fs: float = 360.0, seconds: float = 5.0) -> str:
    """Facts of every tumbling segment; the short tail is kept. One that is flat or has under four samples has a noise of 0."""
    n = max(1, int(seconds * fs))
    return f"""
SELECT z.recording_id, z.segment, n, finite, sd, mean, median, amp, CASE WHEN finite < 4 OR sd < 1e-4 THEN 0.0 ELSE noise END AS noise, kurt, low, high, coalesce(sat, 0.0) AS sat
FROM (SELECT recording_id, CAST(floor(idx / {n}) AS BIGINT) AS segment, count(*) AS n, count(v) AS finite FROM {{s}} AS t GROUP BY recording_id, CAST(floor(idx / {n}) AS BIGINT)) AS z
LEFT JOIN (SELECT recording_id AS r1, segment AS s1, stddev_pop(v) AS sd, avg(v) AS mean, MEDIAN(v) AS median, PCT(v, 0.95) - PCT(v, 0.05) AS amp, stddev_pop(d) / sqrt(2.0) AS noise, KURT(d) AS kurt, PCT(v, 0.01) AS low, PCT(v, 0.99) AS high
           FROM (SELECT recording_id, CAST(floor(idx / {n}) AS BIGINT) AS segment, v, v - lag(v) OVER (PARTITION BY recording_id, CAST(floor(idx / {n}) AS BIGINT) ORDER BY idx) AS d FROM {{s}} AS a WHERE v IS NOT NULL) AS b
           GROUP BY recording_id, segment) AS f ON z.recording_id = r1 AND z.segment = s1
LEFT JOIN (SELECT a.recording_id AS r2, a.segment AS s2, avg(CASE WHEN high - low < 1e-9 OR v >= high - 0.02 * (high - low) OR v <= low + 0.02 * (high - low) THEN 1.0 ELSE 0.0 END) AS sat
           FROM (SELECT recording_id, CAST(floor(idx / {n}) AS BIGINT) AS segment, v FROM {{s}} AS q WHERE v IS NOT NULL) AS a
           JOIN (SELECT recording_id AS r3, CAST(floor(idx / {n}) AS BIGINT) AS s3, PCT(v, 0.01) AS low, PCT(v, 0.99) AS high FROM {{s}} AS p WHERE v IS NOT NULL GROUP BY recording_id, CAST(floor(idx / {n}) AS BIGINT)) AS e ON a.recording_id = r3 AND a.segment = s3
           GROUP BY a.recording_id, a.segment) AS g ON z.recording_id = r2 AND z.segment = s2
"""


def segment_stats(fs: float = 360.0, seconds: float = 5.0) -> str:
    return f"SELECT recording_id, segment, n, finite, round(sd, 6) AS sd, round(median, 6) AS baseline_offset, round(amp, 6) AS amplitude, round(noise, 6) AS noise_rms, round(kurt, 4) AS step_kurtosis FROM ({segments(fs, seconds)}) AS h"


def segment_saturation(fs: float = 360.0, seconds: float = 5.0) -> str:
    return f"SELECT recording_id, segment, round(sat, 6) AS saturation_fraction, {level('sat', 0.01, 0.05)} AS level FROM ({segments(fs, seconds)}) AS h WHERE finite >= 4"


def segment_flatline(fs: float = 360.0, seconds: float = 5.0) -> str:
    return f"SELECT recording_id, segment, coalesce(sd < 1e-4, false) AS flatline FROM ({segments(fs, seconds)}) AS h"


def segment_noise_ratio(fs: float = 360.0, seconds: float = 5.0) -> str:
    return f"SELECT recording_id, segment, round(noise / prev, 6) AS ratio, CASE WHEN noise / prev > 3 THEN 'Motion artifact' WHEN noise / prev > 1.5 THEN 'Noise increased' ELSE 'Stable' END AS verdict FROM (SELECT *, CASE WHEN lag(noise) OVER (PARTITION BY recording_id ORDER BY segment) > 1e-9 THEN lag(noise) OVER (PARTITION BY recording_id ORDER BY segment) END AS prev FROM ({segments(fs, seconds)}) AS h) AS i"


def status(fs: float = 360.0, seconds: float = 5.0, shift: float = 0.15) -> str:
    """The status cascade; a shift of the histogram against the segment before overrides whatever it gave."""
    n = max(1, int(seconds * fs))
    return f"""
SELECT *, CASE WHEN finite < 4 OR sd < 1e-4 THEN 0.0 ELSE least(1.0, greatest(0.0, qrs * (0.5 + 0.5 * (1 - sat)) * CASE WHEN sat >= 0.05 THEN 0.0 ELSE 1.0 END * CASE WHEN finite < 0.99 * n THEN 0.5 ELSE 1.0 END)) END AS reliability,
       CASE WHEN round(kl, 9) > {shift} THEN 'Noise profile changed' WHEN finite < 4 THEN 'Missing data' WHEN sd < 1e-4 THEN 'Flatline' WHEN kurt > 10 THEN 'Motion artifact' WHEN prev > 1e-9 AND noise / prev > 3 THEN 'Motion artifact' WHEN prev > 1e-9 AND noise / prev > 1.5 THEN 'Noise increased'
            WHEN round(slow, 9) > 0.4 THEN 'Baseline drift increasing' WHEN sat >= 0.05 THEN 'Signal saturation' WHEN finite < 0.99 * n THEN 'Missing data' WHEN qrs < 0.1 THEN 'Weak QRS' ELSE 'Stable' END AS status
FROM (SELECT h.*, slow, kl, least(1.0, greatest(0.0, amp / (noise * 6 + 1e-9))) AS qrs, lag(noise) OVER (PARTITION BY recording_id ORDER BY segment) AS prev FROM ({segments(fs, seconds)}) AS h
      LEFT JOIN (SELECT recording_id AS r5, grp AS s5, low AS slow FROM ({low_share(f"CAST(floor(idx / {n}) AS BIGINT)", fs, 256)}) AS hl) AS hm ON recording_id = r5 AND segment = s5
      LEFT JOIN (SELECT recording_id AS r6, grp AS s6, kl FROM ({kl_before(fs, seconds)}) AS hk) AS hn ON recording_id = r6 AND segment = s6) AS i
"""


def segment_status(fs: float = 360.0, seconds: float = 5.0) -> str:
    return f"SELECT recording_id, segment, status, round(qrs, 6) AS qrs_strength, round(reliability, 6) AS reliability, finite < 0.99 * n AS has_missing FROM ({status(fs, seconds)}) AS j"


def status_rollup(fs: float = 360.0, seconds: float = 5.0) -> str:
    return f"SELECT recording_id, status, count(*) AS segments, round(avg(reliability), 6) AS mean_reliability FROM ({status(fs, seconds)}) AS j GROUP BY ROLLUP (recording_id, status)"


def amplitude_jump(fs: float = 360.0, seconds: float = 5.0) -> str:
    return f"""
SELECT recording_id, CASE WHEN max(n) < 4 OR max(mid) < 1e-9 THEN false ELSE coalesce(max(CASE WHEN step > 5 * mid THEN 1 ELSE 0 END), 0) = 1 END AS jump, max(n) AS segments
FROM (SELECT a.recording_id, step, n, mid FROM (SELECT recording_id, abs(noise - lag(noise) OVER (PARTITION BY recording_id ORDER BY segment)) AS step, count(*) OVER (PARTITION BY recording_id) AS n FROM ({segments(fs, seconds)}) AS h) AS a
      JOIN (SELECT recording_id AS rid, MEDIAN(step) AS mid FROM (SELECT recording_id, abs(noise - lag(noise) OVER (PARTITION BY recording_id ORDER BY segment)) AS step FROM ({segments(fs, seconds)}) AS h2) AS b GROUP BY recording_id) AS c ON a.recording_id = rid) AS d
GROUP BY recording_id
"""


def histogram(group: str, bins: int = 32) -> str:
    """Counts of equal-width bins over each group's own range, empty bins included; a constant group falls in the middle bin, one without values is even."""
    return f"""
SELECT g.recording_id, g.grp, bin, coalesce(c, 0) + 1e-9 AS c, total + {bins} * 1e-9 AS total
FROM (SELECT recording_id, grp, count(v) AS total, bin FROM (SELECT recording_id, {group} AS grp, v FROM {{s}} AS a) AS b, SEQ(0, {bins - 1}, u, bin) GROUP BY recording_id, grp, bin) AS g
LEFT JOIN (SELECT recording_id AS r1, grp AS g1, b1, count(*) AS c
           FROM (SELECT recording_id, grp, CASE WHEN hi = lo THEN {bins // 2} ELSE least({bins - 1}, CAST(floor((v - lo) / (hi - lo) * {bins}) AS BIGINT)) END AS b1
                 FROM (SELECT recording_id, grp, v, min(v) OVER (PARTITION BY recording_id, grp) AS lo, max(v) OVER (PARTITION BY recording_id, grp) AS hi FROM (SELECT recording_id, {group} AS grp, v FROM {{s}} AS a2 WHERE v IS NOT NULL) AS d) AS e) AS f
           GROUP BY recording_id, grp, b1) AS h ON g.recording_id = r1 AND g.grp = g1 AND g.bin = b1
"""


def hist_entropy(bins: int = 32) -> str:
    return f"SELECT recording_id, round(least(1.0, greatest(0.0, CASE WHEN max(total) < 4 THEN 0.0 ELSE -sum(c / total * log2(c / total)) / log2({bins}) END)), 6) AS entropy FROM ({histogram('0')}) AS k GROUP BY recording_id"


def kl_before(fs: float = 360.0, seconds: float = 5.0) -> str:
    """Symmetric divergence of every segment's histogram from that of the segment before."""
    n = max(1, int(seconds * fs))
    return f"""
SELECT recording_id, grp, (sum(p * ln(p / q)) + sum(q * ln(q / p))) / 2 AS kl
FROM (SELECT recording_id, grp, p, lag(p) OVER (PARTITION BY recording_id, bin ORDER BY grp) AS q
      FROM (SELECT recording_id, grp, bin, (c / total + 1e-9) / (1 + 32e-9) AS p FROM ({histogram(f"CAST(floor(idx / {n}) AS BIGINT)")}) AS k) AS l) AS m
WHERE q IS NOT NULL GROUP BY recording_id, grp
"""


def segment_kl_shift(fs: float = 360.0, seconds: float = 5.0, shift: float = 0.15) -> str:
    return f"SELECT recording_id, grp AS segment, round(kl, 5) AS kl, kl > {shift} AS shifted FROM ({kl_before(fs, seconds)}) AS o"


def segment_drift(fs: float = 360.0, seconds: float = 5.0) -> str:
    return f"SELECT recording_id, grp AS segment, round(low, 6) AS low_share, round(low, 9) > 0.4 AS drifting FROM ({low_share(f'CAST(floor(idx / {max(1, int(seconds * fs))}) AS BIGINT)', fs)}) AS o"


def noise_type_vote() -> str:
    """Votes of the issues found in a noise profile ``s(recording_id, emg_severity, baseline, motion, powerline, saturated)``."""
    return """
SELECT recording_id, votes, CASE WHEN votes = 0 THEN 'Clean' WHEN votes > 2 THEN 'Mixed noise' WHEN most = emg THEN 'EMG contamination' WHEN most = base THEN 'Baseline wander' WHEN most = mot THEN 'Motion artifact' WHEN most = pow_ THEN 'Powerline interference' ELSE 'Saturation' END AS noise_type
FROM (SELECT *, greatest(emg, base, mot, pow_, sat) AS most, CASE WHEN emg > 0 THEN 1 ELSE 0 END + CASE WHEN base > 0 THEN 1 ELSE 0 END + CASE WHEN mot > 0 THEN 1 ELSE 0 END + CASE WHEN pow_ > 0 THEN 1 ELSE 0 END + CASE WHEN sat > 0 THEN 1 ELSE 0 END AS votes
      FROM (SELECT recording_id, CASE emg_severity WHEN 'SEVERE EMG' THEN 3.0 WHEN 'MODERATE EMG' THEN 2.0 WHEN 'MILD EMG' THEN 1.0 ELSE 0.0 END AS emg, CASE WHEN baseline > 0.40 THEN 2.5 WHEN baseline > 0.15 THEN 1.5 ELSE 0.0 END AS base,
                   CASE WHEN motion > 15 THEN 2.0 ELSE 0.0 END AS mot, CASE WHEN powerline THEN 1.0 ELSE 0.0 END AS pow_, CASE WHEN saturated THEN 2.5 ELSE 0.0 END AS sat FROM {s} AS a) AS b) AS c
"""


DOMINANT_EMG = """
SELECT recording_id, CASE worst WHEN 3 THEN 'SEVERE EMG' WHEN 2 THEN 'MODERATE EMG' WHEN 1 THEN 'MILD EMG' ELSE 'CLEAN' END AS emg_severity, segments
FROM (SELECT recording_id, max(CASE emg_severity WHEN 'SEVERE EMG' THEN 3 WHEN 'MODERATE EMG' THEN 2 WHEN 'MILD EMG' THEN 1 ELSE 0 END) AS worst, count(*) AS segments FROM {s} AS a GROUP BY recording_id) AS b
"""
