"""What a dashboard asks of a recording: perturbed copies, what a filter changed, reliabilities, label checks."""

from __future__ import annotations

from ..sources.signals import NOISE
from .spectral import low_share

#: Perturbed copies of every recording; ``kind`` names the copy. Which samples go missing follows from their number.
PERTURBATIONS = """
SELECT a.recording_id, kind, idx,
       CASE kind WHEN 'baseline' THEN v + 0.5 * sin(0.6283185307179586 * idx / 360.0) WHEN 'powerline' THEN v + 0.3 * sin(0.8726646259971648 * idx) WHEN 'inverted' THEN -v
                 WHEN 'emg' THEN v + 0.8 * {noise} WHEN 'motion' THEN v + CASE WHEN idx >= n / 2 - 0.5 AND idx < n / 2 - 0.5 + 720 THEN 2.0 * {noise} ELSE 0.0 END WHEN 'combined' THEN v + 0.3 * sin(0.0026179938779914945 * idx) + 0.3 * {noise}
                 WHEN 'missing' THEN CASE WHEN idx % 10 <> 3 THEN v END WHEN 'patch' THEN CASE WHEN idx < n / 2 - 0.5 OR idx >= n / 2 - 0.5 + 180 THEN v END WHEN 'powerline60' THEN v + 0.3 * sin(1.0471975511965976 * idx) WHEN 'saturated' THEN greatest(-cap, least(cap, v)) ELSE v END AS v
FROM {s} AS a JOIN (SELECT recording_id AS rid, count(*) AS n, PCT(abs(v), 0.85) AS cap FROM {s} AS b GROUP BY recording_id) AS c ON a.recording_id = rid
CROSS JOIN (SELECT 'clean' AS kind UNION ALL SELECT 'baseline' UNION ALL SELECT 'powerline' UNION ALL SELECT 'inverted' UNION ALL SELECT 'missing' UNION ALL SELECT 'saturated' UNION ALL SELECT 'emg' UNION ALL SELECT 'motion' UNION ALL SELECT 'combined' UNION ALL SELECT 'patch' UNION ALL SELECT 'powerline60') AS k
""".replace("{noise}", NOISE)
PERTURBATION_FACTS = f"SELECT recording_id, kind, count(*) AS n, count(v) AS present, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(max(abs(v)), 6) AS peak FROM ({PERTURBATIONS}) AS p GROUP BY recording_id, kind"


def what_changed(fs: float = 360.0) -> str:
    """Measured differences between a raw wave ``s`` and a processed one ``f``, and the findings they stand for."""
    low = low_share("0", fs, 512)
    return f"""
SELECT recording_id, round(noise_ratio, 5) AS noise_ratio, round(amplitude_ratio, 5) AS amplitude_ratio, round(removed_pct, 4) AS removed_pct, round(low_before, 5) AS low_before, round(low_after, 5) AS low_after,
       CASE WHEN round(low_before - low_after, 9) > 0.05 THEN 'baseline wander reduced' WHEN round(low_after - low_before, 9) > 0.05 THEN 'low-frequency content retained' ELSE '' END AS low_finding,
       CASE WHEN noise_ratio < 0.85 THEN 'high-frequency noise reduced' WHEN abs(noise_ratio - 1) < 0.15 THEN 'noise level preserved' ELSE '' END AS noise_finding,
       CASE WHEN amplitude_ratio BETWEEN 0.85 AND 1.15 THEN 'morphology preserved' WHEN amplitude_ratio < 0.85 THEN 'amplitude reduced' ELSE '' END AS amplitude_finding,
       round(snr_after - snr_before, 5) AS snr_change, CASE WHEN snr_after - snr_before > 1 THEN 'SNR improved' WHEN abs(snr_after - snr_before) <= 1 THEN 'SNR stable' ELSE '' END AS snr_finding,
       CASE WHEN removed_pct < 5 THEN 'small' WHEN removed_pct < 25 THEN 'moderate' ELSE 'significant' END AS removed_finding
FROM (SELECT recording_id, stddev_pop(df) / NULLIF(stddev_pop(ds), 0) AS noise_ratio, PCT(abs(f), 0.95) / NULLIF(PCT(abs(s), 0.95), 0) AS amplitude_ratio, 100 * sqrt(avg((s - f) * (s - f))) / NULLIF(sqrt(avg(f * f)), 0) AS removed_pct,
             20 * log10((PCT(s, 0.95) - PCT(s, 0.05)) / NULLIF(stddev_pop(ds) / sqrt(2.0), 0)) AS snr_before, 20 * log10((PCT(f, 0.95) - PCT(f, 0.05)) / NULLIF(stddev_pop(df) / sqrt(2.0), 0)) AS snr_after
      FROM (SELECT a.recording_id, a.v AS s, b.v AS f, a.v - lag(a.v) OVER (PARTITION BY a.recording_id ORDER BY a.idx) AS ds, b.v - lag(b.v) OVER (PARTITION BY a.recording_id ORDER BY a.idx) AS df
            FROM {{s}} AS a JOIN {{f}} AS b ON a.recording_id = b.recording_id AND a.idx = b.idx) AS c GROUP BY recording_id) AS d
LEFT JOIN (SELECT recording_id AS r1, low AS low_before FROM ({low}) AS l1) AS l2 ON recording_id = r1
LEFT JOIN (SELECT recording_id AS r2, low AS low_after FROM ({low.replace("{s}", "{f}")}) AS l3) AS l4 ON recording_id = r2
"""


#: Reliability of detections: by the batch rule from quality and regularity, and by the segment rule.
RELIABILITY = """
SELECT f.recording_id, round(least(1.0, greatest(0.0, 0.5 * quality + 0.5 * greatest(0.0, 1 - 2 * cv) - least(0.5, 2 * emg))), 6) AS batch_reliability,
       round(least(1.0, greatest(0.0, (1 - least(2 * cv, 1.0)) * (0.4 + 0.6 * quality) * CASE WHEN beats / (span / 60) BETWEEN 40 AND 200 THEN 1.0 ELSE 0.5 END)), 6) AS segment_reliability
FROM {f} AS f JOIN {q} AS q ON f.recording_id = q.recording_id
"""

#: Whether two rhythm labels agree: the same text, or one of these words in both (fixed values).
KEYWORDS = ("normal", "tach", "brady", "fibrill", "flutter", "vt", "vf", "irregular")


def rhythm_match() -> str:
    both = " OR ".join(f"(lower(label) LIKE '%{k}%' AND lower(reference) LIKE '%{k}%')" for k in KEYWORDS)
    return f"SELECT recording_id, label, reference, lower(label) = lower(reference) OR {both} AS agrees FROM {{l}} AS a"


MOTION = """
SELECT recording_id, quality, CASE WHEN snr_db IS NULL THEN 'Data unavailable' WHEN quality = 'GOOD' AND snr_db > 15 THEN 'STATIONARY' WHEN quality = 'MODERATE' THEN 'LOW MOTION' WHEN quality = 'POOR' THEN 'MODERATE MOTION' WHEN quality = 'CRITICAL' THEN 'HIGH MOTION' ELSE 'Data unavailable' END AS motion FROM {s} AS a
"""
