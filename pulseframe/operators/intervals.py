"""Peaks, beat intervals and what is derived from them.

``p(recording_id, idx, fs)`` are peaks; intervals count if 0.2 s to 3 s long.
"""

from __future__ import annotations

W = "(PARTITION BY recording_id ORDER BY idx)"


def local_maxima(share: float = 0.6) -> str:
    """Strict local maxima of at least ``share`` of the recording's range above its least sample."""
    return f"""
SELECT recording_id, idx, round(v, 6) AS v
FROM (SELECT recording_id, idx, v, lag(v) OVER {W} AS pv, lead(v) OVER {W} AS nv, min(v) OVER (PARTITION BY recording_id) AS lo, max(v) OVER (PARTITION BY recording_id) AS hi FROM {{s}} AS a) AS b
WHERE v > pv AND v > nv AND v >= lo + {share} * (hi - lo)
"""


RR = f"SELECT recording_id, idx, beat, rr, fs FROM (SELECT recording_id, idx, fs, row_number() OVER {W} - 1 AS beat, (idx - lag(idx) OVER {W}) / fs AS rr FROM {{p}} AS a) AS b WHERE rr IS NOT NULL"
VALID = f"SELECT * FROM ({RR}) AS c WHERE rr BETWEEN 0.2 AND 3.0"

RR_INTERVALS = f"SELECT recording_id, beat, round(rr, 6) AS rr_s, rr BETWEEN 0.2 AND 3.0 AS valid FROM ({RR}) AS c"
HR_SERIES = f"SELECT recording_id, beat, round(idx / fs - rr / 2, 6) AS t_s, round(CASE WHEN rr > 0.2 AND rr < 3.0 THEN 60 / rr END, 6) AS bpm FROM ({RR}) AS c"
INTERVAL_TILES = f"SELECT recording_id, round(MEDIAN(rr) * 1000, 3) AS median_ms, round(min(rr) * 1000, 3) AS min_ms, round(max(rr) * 1000, 3) AS max_ms, round(stddev_pop(rr) * 1000, 3) AS std_ms FROM ({VALID}) AS c GROUP BY recording_id"


def runs(limit: str = "0.5") -> str:
    """Runs of consecutive valid intervals shorter than ``limit`` seconds: islands by the difference of two row numbers."""
    return f"""
SELECT recording_id, island, count(*) AS length, min(k) AS first_k
FROM (SELECT recording_id, k, k - row_number() OVER (PARTITION BY recording_id ORDER BY k) AS island FROM (SELECT recording_id, rr, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS k FROM ({VALID}) AS c) AS d WHERE rr < {limit}) AS e
GROUP BY recording_id, island
"""


LONGEST_RUN = f"SELECT v.recording_id, count(*) AS intervals, coalesce(max(longest), 0) AS longest_rapid_run FROM ({VALID}) AS v LEFT JOIN (SELECT recording_id AS rid, max(length) AS longest FROM ({runs()}) AS f GROUP BY recording_id) AS g ON v.recording_id = rid GROUP BY v.recording_id"

FIRST_RUN_LATENCY = """
SELECT recording_id, onset, round(latency, 6) AS latency_s, latency <= 3.0 AS target_met
FROM (SELECT recording_id, k - 3 AS onset, total AS latency, row_number() OVER (PARTITION BY recording_id ORDER BY k) AS nth
      FROM (SELECT recording_id, k, sum(CASE WHEN rr < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rapid, sum(rr) OVER (PARTITION BY recording_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS total
            FROM (SELECT recording_id, rr, row_number() OVER (PARTITION BY recording_id ORDER BY idx) - 1 AS k FROM ({rr}) AS c) AS d) AS e
      WHERE rapid = 4) AS f
WHERE nth = 1
""".replace("{rr}", RR)

ENTROPY = f"""
SELECT recording_id AS er, least(1.0, greatest(0.0, CASE WHEN max(n) < 4 THEN 0.0 ELSE -sum(c / (n + 32e-9) * log2(c / (n + 32e-9))) / log2(32) END)) AS entropy
FROM (SELECT g.recording_id, g.bin, n, coalesce(k, 0) + 1e-9 AS c
      FROM (SELECT recording_id, n, bin FROM (SELECT recording_id, count(*) AS n FROM ({VALID}) AS a GROUP BY recording_id) AS b, SEQ(0, 31, u, bin)) AS g
      LEFT JOIN (SELECT recording_id AS r1, b1, count(*) AS k FROM (SELECT recording_id, CASE WHEN hi = lo THEN 16 ELSE least(31, CAST(floor((rr - lo) / (hi - lo) * 32) AS BIGINT)) END AS b1 FROM (SELECT recording_id, rr, min(rr) OVER (PARTITION BY recording_id) AS lo, max(rr) OVER (PARTITION BY recording_id) AS hi FROM ({VALID}) AS c) AS d) AS e GROUP BY recording_id, b1) AS h
        ON g.recording_id = r1 AND g.bin = b1) AS i GROUP BY recording_id
"""

FEATURES = f"""
SELECT f.*, cv_regular, coalesce(entropy, 0.0) AS entropy, coalesce(longest, 0) / n AS sustained, coalesce(longest43, 0) / n AS sustained43, beats
FROM (SELECT *, sd / mean AS cv, 60 / median AS hr, least(1.0, greatest(0.0, 1 - 3 * sd / mean)) AS cv_regular
      FROM (SELECT recording_id, count(*) AS n, avg(rr) AS mean, MEDIAN(rr) AS median, stddev_pop(rr) AS sd, min(rr) AS least_rr, max(rr) AS pause, coalesce(sqrt(avg(d * d)), 0.0) AS rmssd, coalesce(avg(CASE WHEN abs(d) > 50 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 0.0) AS pnn50, avg(CASE WHEN rr < 0.3 THEN 1.0 ELSE 0.0 END) AS short
            FROM (SELECT recording_id, rr, (rr - lag(rr) OVER {W}) * 1000 AS d FROM ({VALID}) AS a) AS b GROUP BY recording_id) AS c) AS f
JOIN ({ENTROPY}) AS e ON f.recording_id = er
JOIN (SELECT recording_id AS r5, count(*) AS beats FROM {{p}} AS pp GROUP BY recording_id) AS pc ON f.recording_id = r5
LEFT JOIN (SELECT recording_id AS r2, max(length) AS longest FROM ({runs()}) AS g GROUP BY recording_id) AS h ON f.recording_id = r2
LEFT JOIN (SELECT recording_id AS r3, max(length) AS longest43 FROM ({runs('0.43')}) AS g2 GROUP BY recording_id) AS h2 ON f.recording_id = r3
"""

RR_FEATURES = f"""
SELECT recording_id, n, round(mean, 6) AS mean_rr, round(median, 6) AS median_rr, round(sd, 6) AS std_rr, round(least_rr, 6) AS min_rr, round(pause, 6) AS longest_pause, round(hr, 4) AS heart_rate, round(cv, 6) AS cv, round(rmssd, 4) AS rmssd_ms,
       round(pnn50, 6) AS pnn50, round(cv_regular, 6) AS regularity, round(entropy, 6) AS entropy, round(short, 6) AS short_fraction, round(sustained, 6) AS sustained_rapid
FROM ({FEATURES}) AS z
"""

# --- rules --------------------------------------------------------------------

VT = """
SELECT *, CASE WHEN hr >= 120 THEN 0.30 + CASE WHEN sustained >= 0.70 THEN 0.25 ELSE 0 END + CASE WHEN cv_regular >= 0.55 THEN 0.20 ELSE 0 END + CASE WHEN beats >= 6 THEN 0.15 ELSE 0 END + CASE WHEN entropy < 0.35 THEN 0.10 ELSE 0 END ELSE 0 END AS vt,
          CASE WHEN entropy > 0.65 AND cv > 0.20 THEN 0.25 ELSE 0 END AS vf
FROM ({f}) AS z WHERE n >= 2 AND beats >= 4
""".replace("{f}", FEATURES)

VT_EVIDENCE = f"""
SELECT recording_id, round(CASE WHEN vt >= 0.6499999 THEN vt ELSE 0 END, 4) AS vt_score, vt >= 0.6499999 AS possible_vt,
       CASE WHEN vt >= 0.6499999 THEN concat('Rapid rate: ', CAST(CAST(HALFEVEN(hr, 0) AS BIGINT) AS VARCHAR(20)), ' BPM (>=120)', CASE WHEN sustained >= 0.70 THEN ' | Sustained rapid beats' ELSE '' END, CASE WHEN cv_regular >= 0.55 THEN ' | Regular rhythm' ELSE '' END, CASE WHEN beats >= 6 THEN ' | Sustained observation' ELSE '' END, CASE WHEN entropy < 0.35 THEN ' | Low RR entropy (regular)' ELSE '' END) ELSE '' END AS evidence
FROM ({VT}) AS y
"""
VF_EVIDENCE = f"SELECT recording_id, round(vf, 4) AS vf_interval_score, CASE WHEN vf > 0 THEN 'Disorganized RR' ELSE '' END AS evidence, round(entropy, 6) AS entropy, round(cv, 6) AS cv FROM ({VT}) AS y"

CONFIDENCE = "CASE WHEN conf >= 0.70 THEN 'HIGH' WHEN conf >= 0.45 THEN 'MODERATE' WHEN conf >= 0.20 THEN 'LOW' ELSE 'UNRELIABLE' END"

#: Rhythm by the batch rules, over interval features alone (wave evidence for VF is added by the pipeline).
RHYTHM_LABEL = f"""
SELECT recording_id, label, round(conf, 4) AS confidence_score, {CONFIDENCE} AS confidence
FROM (SELECT recording_id, label, least(1.0, greatest(0.0, CASE label WHEN 'Possible Ventricular Tachycardia' THEN vt WHEN 'Possible Atrial Fibrillation' THEN least(0.85, greatest(0.3, 0.5 + cv * 2)) WHEN 'Sinus Tachycardia' THEN 0.7 + 0.3 * cv_regular WHEN 'Sinus Bradycardia' THEN 0.7 + 0.3 * cv_regular WHEN 'Normal Sinus Rhythm' THEN 0.6 + 0.4 * cv_regular ELSE 0.5 END)) AS conf
      FROM (SELECT *, CASE WHEN vt >= 0.6499999 THEN 'Possible Ventricular Tachycardia' WHEN cv >= 0.10 AND pnn50 >= 0.15 AND rmssd > 40 AND entropy > 0.4 THEN 'Possible Atrial Fibrillation' WHEN hr >= 100 THEN 'Sinus Tachycardia' WHEN hr < 60 THEN 'Sinus Bradycardia' WHEN cv_regular > 0.5 THEN 'Normal Sinus Rhythm' ELSE 'Irregular Rhythm' END AS label FROM ({VT}) AS y) AS x) AS w
"""

#: Rhythm by the modular rules: beats ``p`` and what is known of a recording's wave, ``w(recording_id, amplitude_cv, quality, severity)``, whose absence neither adds evidence nor takes confidence.
#: Any evidence sets a flag; the label changes where its score is over a half, fibrillation first. Every recording with beats gets a row.
RHYTHM_MODULAR = f"""
SELECT recording_id, CASE WHEN mvf > 0.5 THEN 'Possible Ventricular Fibrillation' WHEN mvt > 0.5 THEN 'Possible Ventricular Tachycardia' ELSE label END AS label, round(conf, 4) AS confidence_score, {CONFIDENCE} AS confidence, mvt > 0 AS possible_vt, mvf > 0 AS possible_vf, round(mvt, 4) AS vt_score, round(mvf, 4) AS vf_score
FROM (SELECT *, least(1.0, CASE WHEN n < 6 THEN greatest(0.0, seen - 0.20) ELSE seen END) AS conf
      FROM (SELECT *, greatest(0.0, greatest(0.0, base - CASE WHEN severity LIKE '%SEVERE%' THEN 0.35 WHEN severity LIKE '%MODERATE%' THEN 0.15 ELSE 0 END) - CASE WHEN quality IN ('POOR', 'CRITICAL') THEN 0.25 ELSE 0 END) AS seen
            FROM (SELECT *, CASE label WHEN 'Unknown / Unclassifiable' THEN 0.0 WHEN 'Possible Atrial Fibrillation' THEN least(1.0, greatest(0.0, 0.5 + 0.5 * least(cv / 0.20, 1.0) + 0.2 * least(pnn50 / 0.30, 1.0) - CASE WHEN hr > 150 THEN 0.3 ELSE 0 END)) WHEN 'Sinus Tachycardia' THEN 0.7 + 0.3 * cv_regular WHEN 'Sinus Bradycardia' THEN 0.7 + 0.3 * cv_regular WHEN 'Irregular Rhythm' THEN 0.5 ELSE CASE WHEN cv_regular > 0.5 THEN 0.6 + 0.4 * cv_regular ELSE 0.65 END END AS base
                  FROM (SELECT k.recording_id, n, cv, pnn50, hr, cv_regular, quality, severity,
                               CASE WHEN n IS NULL THEN 'Unknown / Unclassifiable' WHEN cv >= 0.10 AND pnn50 >= 0.15 AND rmssd > 40 AND entropy > 0.4 THEN 'Possible Atrial Fibrillation' WHEN hr >= 100 THEN 'Sinus Tachycardia' WHEN hr < 60 THEN 'Sinus Bradycardia' WHEN cv_regular > 0.5 THEN 'Normal Sinus Rhythm' WHEN cv > 0.05 THEN 'Irregular Rhythm' ELSE 'Normal Sinus Rhythm' END AS label,
                               CASE WHEN hr >= 120 THEN 0.4 ELSE 0 END + CASE WHEN sustained43 >= 0.75 THEN 0.4 ELSE 0 END + CASE WHEN cv_regular >= 0.6 AND (hr >= 120 OR sustained43 >= 0.75) THEN 0.2 ELSE 0 END AS mvt,
                               CASE WHEN entropy > 0.65 THEN 0.3 ELSE 0 END + CASE WHEN cv > 0.25 THEN 0.2 ELSE 0 END + CASE WHEN n IS NOT NULL AND amplitude_cv > 0.50 THEN 0.2 ELSE 0 END + CASE WHEN quality IN ('POOR', 'CRITICAL') AND hr > 150 THEN 0.1 ELSE 0 END AS mvf
                        FROM (SELECT recording_id FROM {{p}} AS pk GROUP BY recording_id) AS k LEFT JOIN ({VT}) AS y ON k.recording_id = y.recording_id LEFT JOIN {{w}} AS w ON k.recording_id = w.recording_id) AS x) AS v) AS u) AS t
"""


#: The same from its rules, for DuckDB alone, over lists of beats.
MODULAR_DUCKDB = """
WITH b AS (SELECT recording_id, any_value(fs) AS fs, list(idx ORDER BY idx) AS ix FROM ({p}) GROUP BY recording_id),
r AS (SELECT recording_id, len(ix) AS beats, list_filter(list_transform(generate_series(2, len(ix)), lambda k: (ix[k] - ix[k - 1]) / fs), lambda x: x >= 0.2 AND x <= 3.0) AS rr FROM b),
d AS (SELECT *, list_transform(generate_series(2, len(rr)), lambda k: 1000 * (rr[k] - rr[k - 1])) AS d, list_transform(rr, lambda x: CASE WHEN list_max(rr) = list_min(rr) THEN 16 ELSE least(31, CAST(floor((x - list_min(rr)) / (list_max(rr) - list_min(rr)) * 32) AS INT)) END) AS bin FROM r WHERE beats >= 4 AND len(rr) >= 2),
f AS (SELECT recording_id, len(rr) AS n, list_stddev_pop(rr) / list_avg(rr) AS cv, 60 / list_median(rr) AS hr, sqrt(list_avg(list_transform(d, lambda x: x * x))) AS rmssd, len(list_filter(d, lambda x: abs(x) > 50)) / len(d) AS pnn50,
             list_transform(range(32), lambda k: len(list_filter(bin, lambda x: x = k)) + 1e-9) AS hist,
             list_max(list_transform(generate_series(1, len(rr)), lambda a: coalesce(list_min(list_filter(generate_series(a, len(rr)), lambda z: rr[z] >= 0.43)), len(rr) + 1) - a)) / len(rr) AS rapid FROM d),
g AS (SELECT *, least(1, greatest(0, 1 - 3 * cv)) AS regular, CASE WHEN n < 4 THEN 0 ELSE -list_sum(list_transform(hist, lambda c: c / list_sum(hist) * log2(c / list_sum(hist)))) / 5 END AS entropy FROM f),
s AS (SELECT b.recording_id, g.* EXCLUDE (recording_id), g.n IS NOT NULL AS told, coalesce(quality IN ('POOR', 'CRITICAL'), false) AS poor, coalesce(severity, '') AS severity,
             CASE WHEN hr >= 120 THEN 4 ELSE 0 END + CASE WHEN rapid >= 0.75 THEN 4 ELSE 0 END AS rate, CASE WHEN entropy > 0.65 THEN 3 ELSE 0 END + CASE WHEN cv > 0.25 THEN 2 ELSE 0 END + CASE WHEN told AND amplitude_cv > 0.5 THEN 2 ELSE 0 END + CASE WHEN told AND poor AND hr > 150 THEN 1 ELSE 0 END AS vf
      FROM b LEFT JOIN g USING (recording_id) LEFT JOIN ({w}) AS w USING (recording_id)),
t AS (SELECT *, rate + CASE WHEN rate > 0 AND regular >= 0.6 THEN 2 ELSE 0 END AS vt, CASE WHEN NOT told THEN 'U' WHEN cv >= 0.1 AND pnn50 >= 0.15 AND rmssd > 40 AND entropy > 0.4 THEN 'A' WHEN hr >= 100 THEN 'T' WHEN hr < 60 THEN 'B' WHEN regular > 0.5 OR cv <= 0.05 THEN 'N' ELSE 'I' END AS kind FROM s),
c AS (SELECT *, CASE kind WHEN 'U' THEN 0 WHEN 'A' THEN least(1, greatest(0, 0.5 + 0.5 * least(cv / 0.2, 1) + 0.2 * least(pnn50 / 0.3, 1) - CASE WHEN hr > 150 THEN 0.3 ELSE 0 END)) WHEN 'I' THEN 0.5 WHEN 'N' THEN CASE WHEN regular > 0.5 THEN 0.6 + 0.4 * regular ELSE 0.65 END ELSE 0.7 + 0.3 * regular END AS c0 FROM t),
e AS (SELECT *, least(1, list_reduce([CASE WHEN contains(severity, 'SEVERE') THEN 0.35 WHEN contains(severity, 'MODERATE') THEN 0.15 ELSE 0 END, CASE WHEN poor THEN 0.25 ELSE 0 END, CASE WHEN n < 6 THEN 0.2 ELSE 0 END], lambda x, y: greatest(0, x - y), CAST(c0 AS DOUBLE))) AS conf FROM c)
SELECT recording_id, CASE WHEN vf > 5 THEN 'Possible Ventricular Fibrillation' WHEN vt > 5 THEN 'Possible Ventricular Tachycardia' ELSE CASE kind WHEN 'U' THEN 'Unknown / Unclassifiable' WHEN 'A' THEN 'Possible Atrial Fibrillation' WHEN 'T' THEN 'Sinus Tachycardia' WHEN 'B' THEN 'Sinus Bradycardia' WHEN 'N' THEN 'Normal Sinus Rhythm' ELSE 'Irregular Rhythm' END END AS label,
       round(conf, 4) AS confidence_score, CASE WHEN conf >= 0.70 THEN 'HIGH' WHEN conf >= 0.45 THEN 'MODERATE' WHEN conf >= 0.20 THEN 'LOW' ELSE 'UNRELIABLE' END AS confidence, vt > 0 AS possible_vt, vf > 0 AS possible_vf, round(vt / 10, 4) AS vt_score, round(vf / 10, 4) AS vf_score FROM e
"""

#: Rhythm by all batch rules: beats ``p`` and what is known of each recording's wave, ``w(recording_id, seconds, amplitude_cv, wave_entropy, quality, severity)``;
#: every recording of ``w`` gets a label. Fibrillation needs signs in the wave besides the intervals, and comes before all other labels.
RHYTHM_BATCH = f"""
SELECT recording_id, label, round(sure, 4) AS confidence_score, {CONFIDENCE.replace("conf ", "sure ")} AS confidence, is_vt AS possible_vt, is_vf AS possible_vf, round(CASE WHEN is_vt THEN vt ELSE 0 END, 4) AS vt_score, round(CASE WHEN is_vf THEN vf ELSE 0 END, 4) AS vf_score
FROM (SELECT *, CASE WHEN told THEN least(1.0, greatest(0.0, greatest(0.0, base - CASE WHEN quality IN ('POOR', 'CRITICAL') THEN 0.25 ELSE 0 END) - CASE WHEN severity LIKE '%SEVERE%' THEN 0.35 WHEN severity LIKE '%MODERATE%' THEN 0.15 ELSE 0 END)) ELSE 0.0 END AS sure
      FROM (SELECT *, CASE label WHEN 'Possible Ventricular Fibrillation' THEN vf WHEN 'Possible Ventricular Tachycardia' THEN vt WHEN 'Possible Atrial Fibrillation' THEN least(0.85, greatest(0.3, 0.5 + 2 * cv)) WHEN 'Sinus Tachycardia' THEN 0.7 + 0.3 * cv_regular WHEN 'Sinus Bradycardia' THEN 0.7 + 0.3 * cv_regular WHEN 'Normal Sinus Rhythm' THEN 0.6 + 0.4 * cv_regular WHEN 'Irregular Rhythm' THEN 0.5 ELSE 0.0 END AS base
            FROM (SELECT *, CASE WHEN known < 4 THEN 'Unknown / Unclassifiable' WHEN seconds > 0 AND seconds < 5 THEN 'Recording Too Short for Rhythm Analysis' WHEN NOT told THEN 'Unknown / Unclassifiable' WHEN is_vf THEN 'Possible Ventricular Fibrillation' WHEN is_vt THEN 'Possible Ventricular Tachycardia'
                              WHEN cv >= 0.10 AND pnn50 >= 0.15 AND rmssd > 40 AND entropy > 0.4 THEN 'Possible Atrial Fibrillation' WHEN hr >= 100 THEN 'Sinus Tachycardia' WHEN hr < 60 THEN 'Sinus Bradycardia' WHEN cv_regular > 0.5 THEN 'Normal Sinus Rhythm' ELSE 'Irregular Rhythm' END AS label
                  FROM (SELECT *, told AND round(vt, 9) >= 0.65 AS is_vt, told AND round(vf, 9) >= 0.55 AS is_vf
                        FROM (SELECT w.recording_id, seconds, quality, severity, cv, pnn50, rmssd, entropy, hr, cv_regular, vt, coalesce(known, 0) AS known, coalesce(known, 0) >= 4 AND NOT (seconds > 0 AND seconds < 5) AND y.recording_id IS NOT NULL AS told,
                                     greatest(0.0, CASE WHEN entropy > 0.65 AND cv > 0.20 THEN 0.25 ELSE 0 END + CASE WHEN amplitude_cv > 0.50 THEN 0.20 ELSE 0 END + CASE WHEN wave_entropy > 0.60 THEN 0.25 ELSE 0 END
                                                   + CASE WHEN seconds >= 5 AND known / greatest(seconds, 1.0) * 60 < 20 AND quality <> 'CRITICAL' THEN 0.30 ELSE 0 END - CASE WHEN quality = 'CRITICAL' AND wave_entropy IS NULL THEN 0.40 ELSE 0 END) AS vf
                              FROM {{w}} AS w LEFT JOIN (SELECT recording_id AS rw, count(*) AS known FROM {{p}} AS pw GROUP BY recording_id) AS k ON w.recording_id = rw LEFT JOIN ({VT}) AS y ON w.recording_id = y.recording_id) AS v1) AS v2) AS v3) AS v4) AS v5
"""

# --- alerts -------------------------------------------------------------------

#: Alerts of recordings that a classifier has flagged - ``g(recording_id, possible_vt, possible_vf, vt_evidence, vf_evidence)``, fibrillation first -
#: under the quality ``q(recording_id, poor, severe, reliability, duration_s)``: limited signals are kept for review, flags without evidence on unreliable beats suppressed.
#: Unknown quality does neither.
ALERTS = f"""
SELECT recording_id, CASE WHEN limited THEN 'Quality-limited alert' WHEN artifact THEN 'Artifact-driven alarm (suppressed)' WHEN possible_vf THEN 'Possible Ventricular Fibrillation' ELSE 'Possible Ventricular Tachycardia' END AS alert_type,
       CASE WHEN limited THEN 'MEDIUM' WHEN artifact THEN 'SUPPRESSED' WHEN possible_vf THEN 'CRITICAL' ELSE 'HIGH' END AS priority, artifact AND NOT limited AS suppressed, limited AS requires_review, coalesce(latency, 0.0) AS latency, duration_s
FROM (SELECT g.recording_id, possible_vf, coalesce(poor AND severe AND reliability < 0.6, false) AS limited, coalesce(reliability < 0.30 AND NOT CASE WHEN possible_vf THEN vf_evidence ELSE vt_evidence END, false) AS artifact, latency, duration_s
      FROM {{g}} AS g LEFT JOIN {{q}} AS q ON g.recording_id = q.recording_id
      LEFT JOIN (SELECT recording_id AS r7, sum(CASE WHEN k <= 4 THEN rr END) AS latency FROM (SELECT recording_id, rr, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS k FROM ({VALID}) AS a7) AS b7 GROUP BY recording_id) AS l ON g.recording_id = r7
      WHERE possible_vt OR possible_vf) AS t
"""
ALERT_SUPPRESSION = f"SELECT recording_id, alert_type, priority, suppressed, requires_review, round(latency, 6) AS latency_s FROM ({ALERTS}) AS a9"
ALERT_ROLLUP = f"""
SELECT priority, count(*) AS alerts, sum(CASE WHEN suppressed THEN 1 ELSE 0 END) AS suppressed, sum(CASE WHEN requires_review THEN 1 ELSE 0 END) AS quality_limited, round(avg(CASE WHEN NOT suppressed THEN latency END), 6) AS mean_latency_s, round(max(CASE WHEN NOT suppressed THEN latency END), 6) AS max_latency_s,
       round(100 * avg(CASE WHEN suppressed THEN NULL WHEN latency <= 3.0 THEN 1.0 ELSE 0.0 END), 4) AS pct_within_target, round(2 * sum(CASE WHEN suppressed THEN 1 ELSE 0 END) / (sum(duration_s) / 3600), 4) AS false_alarms_per_hour, round(sum(CASE WHEN suppressed THEN 1 ELSE 0 END) / (sum(duration_s) / 3600), 4) AS false_alarms_per_hour_once
FROM ({ALERTS}) AS a9 GROUP BY priority
"""


#: The same from its rules, for DuckDB alone, over lists of beats.
ALERTS_DUCKDB = """
WITH beat AS (SELECT recording_id, any_value(fs) AS fs, list(idx ORDER BY idx) AS ix FROM ({p}) GROUP BY recording_id),
rr AS (SELECT recording_id, list_filter(list_transform(generate_series(2, len(ix)), lambda k: (ix[k] - ix[k - 1]) / fs), lambda x: x >= 0.2 AND x <= 3.0) AS rr FROM beat),
flag AS (SELECT g.*, q.* EXCLUDE (recording_id), CASE WHEN possible_vf THEN 'F' WHEN possible_vt THEN 'T' END AS kind FROM ({g}) AS g LEFT JOIN ({q}) AS q USING (recording_id)),
alert AS (SELECT recording_id, duration_s, coalesce(list_sum(rr[1:4]), 0.0) AS latency, CASE WHEN poor AND severe AND reliability < 0.6 THEN 'review' WHEN reliability < 0.3 AND ((kind = 'F' AND NOT vf_evidence) OR (kind = 'T' AND NOT vt_evidence)) THEN 'artifact' ELSE kind END AS verdict
          FROM flag LEFT JOIN rr USING (recording_id) WHERE kind IS NOT NULL),
named AS (SELECT *, verdict = 'artifact' AS suppressed, verdict = 'review' AS requires_review, CASE verdict WHEN 'review' THEN 'MEDIUM' WHEN 'artifact' THEN 'SUPPRESSED' WHEN 'F' THEN 'CRITICAL' ELSE 'HIGH' END AS priority,
                 CASE verdict WHEN 'review' THEN 'Quality-limited alert' WHEN 'artifact' THEN 'Artifact-driven alarm (suppressed)' WHEN 'F' THEN 'Possible Ventricular Fibrillation' ELSE 'Possible Ventricular Tachycardia' END AS alert_type FROM alert)
"""
SUPPRESSION_DUCKDB = ALERTS_DUCKDB + "SELECT recording_id, alert_type, priority, suppressed, requires_review, round(latency, 6) AS latency_s FROM named"
ROLLUP_DUCKDB = ALERTS_DUCKDB + """SELECT priority, count(*) AS alerts, count(*) FILTER (suppressed) AS suppressed, count(*) FILTER (requires_review) AS quality_limited, round(avg(latency) FILTER (NOT suppressed), 6) AS mean_latency_s, round(max(latency) FILTER (NOT suppressed), 6) AS max_latency_s,
       round(100.0 * count(*) FILTER (NOT suppressed AND latency <= 3) / nullif(count(*) FILTER (NOT suppressed), 0), 4) AS pct_within_target, round(2 * count(*) FILTER (suppressed) * 3600 / sum(duration_s), 4) AS false_alarms_per_hour, round(count(*) FILTER (suppressed) * 3600 / sum(duration_s), 4) AS false_alarms_per_hour_once FROM named GROUP BY priority"""
