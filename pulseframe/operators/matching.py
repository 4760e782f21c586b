"""Matching detections with references, agreement of series, and peak-centred windows (morphology)."""

from __future__ import annotations


def matches(tolerance: int) -> str:
    """Pairs of detections and references at most ``tolerance`` samples apart (0: in the same place).

    Each detection's nearest reference (the first on a tie), found by buckets of the tolerance; the first detection of a reference has it.

    A detection's nearest reference doesn't depend on which ones are taken, so
    the greedy pass of one detection after another is a ranking.
    """
    width = max(1, tolerance)
    return f"""
SELECT recording_id, method, det, CASE WHEN nth = 1 THEN ref END AS ref
FROM (SELECT recording_id, method, det, ref, row_number() OVER (PARTITION BY recording_id, method, ref ORDER BY det) AS nth
      FROM (SELECT d.recording_id, d.method, d.idx AS det, r.idx AS ref, row_number() OVER (PARTITION BY d.recording_id, d.method, d.idx ORDER BY abs(d.idx - r.idx), r.idx) AS near
            FROM (SELECT recording_id, method, idx, CAST(floor(idx / {width}.0) AS BIGINT) + o AS bucket FROM {{d}} AS d0, SEQ(-1, 1, u, o)) AS d
            JOIN (SELECT recording_id, idx, CAST(floor(idx / {width}.0) AS BIGINT) AS bucket FROM {{r}} AS r0) AS r ON d.recording_id = r.recording_id AND d.bucket = r.bucket
            WHERE abs(d.idx - r.idx) <= {tolerance}) AS a WHERE near = 1) AS b WHERE nth = 1
"""


def match_metrics(fs: float, tolerance_s: float = 0.05) -> str:
    """Counts and timing errors for every recording that has detections or references, by every method that there is: what a method found nothing in counts, too. Of detections in one place the first may match, the others are false."""
    t = int(tolerance_s * fs)
    return f"""
SELECT recording_id, method, tp, detections - tp AS fp, refs - tp AS fn, round(tp / greatest(detections, 1), 4) AS precision_, round(tp / greatest(refs, 1), 4) AS recall, round(2.0 * tp / greatest(detections + refs, 1), 4) AS f1,
       round(mean_err, 2) AS mean_err_ms, round(std_err, 2) AS std_err_ms, round(mean_abs, 3) AS mean_abs_err_ms, round(max_abs, 3) AS max_abs_err_ms
FROM (SELECT g.recording_id, g.method, coalesce(detections, 0) AS detections, coalesce(tp, 0) AS tp, coalesce(refs, 0) AS refs, mean_err, std_err, mean_abs, max_abs
      FROM (SELECT recording_id, method FROM (SELECT recording_id, (SELECT VALUES_OF(method) FROM {{d}} AS d2) AS every FROM (SELECT recording_id FROM {{d}} AS d1 UNION SELECT recording_id FROM {{r}} AS r1) AS a0) AS a, EACH(every, u, method)) AS g
      LEFT JOIN (SELECT recording_id, count(*) AS refs FROM {{r}} AS r2 GROUP BY recording_id) AS f ON g.recording_id = f.recording_id
      LEFT JOIN (SELECT d.recording_id, d.method, count(*) AS detections, count(m.ref) AS tp, avg((m.det - m.ref) * 1000 / {fs}) AS mean_err, stddev_pop((m.det - m.ref) * 1000 / {fs}) AS std_err, avg(abs(m.det - m.ref) * 1000 / {fs}) AS mean_abs, max(abs(m.det - m.ref) * 1000 / {fs}) AS max_abs
                 FROM (SELECT recording_id, method, idx, row_number() OVER (PARTITION BY recording_id, method, idx ORDER BY idx) AS copy FROM {{d}} AS d3) AS d LEFT JOIN ({matches(t)}) AS m ON d.recording_id = m.recording_id AND d.method = m.method AND d.idx = m.det AND d.copy = 1 GROUP BY d.recording_id, d.method) AS e ON g.recording_id = e.recording_id AND g.method = e.method) AS h
"""


#: The counts from their definition, for DuckDB alone: every detection's nearest reference of all, each reference given to the first of its detections.
METRICS_DUCKDB = """
WITH det AS ({d}), ref AS ({r}), one AS (SELECT DISTINCT recording_id, method, idx FROM det),
near AS (SELECT o.recording_id, o.method, o.idx AS det, min({'away': abs(o.idx - r.idx), 'at': r.idx}) AS x FROM one AS o JOIN ref AS r USING (recording_id) GROUP BY ALL),
hit AS (SELECT recording_id, method, x.at AS ref, min(det) AS det FROM near WHERE x.away <= {t} GROUP BY ALL),
err AS (SELECT recording_id, method, count(*) AS tp, avg(e) AS m, stddev_pop(e) AS s, avg(abs(e)) AS ma, max(abs(e)) AS mx FROM (SELECT *, (det - ref) * 1000 / {fs} AS e FROM hit) GROUP BY ALL),
n AS (SELECT rec.recording_id, method, (SELECT count(*) FROM det AS d WHERE d.recording_id = rec.recording_id AND d.method = met.method) AS k, (SELECT count(*) FROM ref AS r WHERE r.recording_id = rec.recording_id) AS refs
      FROM (SELECT recording_id FROM det UNION SELECT recording_id FROM ref) AS rec CROSS JOIN (SELECT DISTINCT method FROM det) AS met),
c AS (SELECT recording_id, method, coalesce(tp, 0) AS tp, k - coalesce(tp, 0) AS fp, refs - coalesce(tp, 0) AS fn, m, s, ma, mx FROM n LEFT JOIN err USING (recording_id, method))
"""


def metrics_oracle(d: str, r: str, fs: float, tolerance_s: float, by_method: bool = False) -> str:
    text = METRICS_DUCKDB.replace("{t}", str(int(tolerance_s * fs))).replace("{fs}", str(fs)).replace("{d}", d).replace("{r}", r)
    if by_method:
        return text + "SELECT method, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, round(sum(tp) / (sum(tp) + (sum(fp) + sum(fn)) / 2), 4) AS f1 FROM c GROUP BY method"
    return text + """SELECT recording_id, method, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision_, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
       round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + (fp + fn) / 2) ELSE 0.0 END, 4) AS f1, round(m, 2) AS mean_err_ms, round(s, 2) AS std_err_ms, round(ma, 3) AS mean_abs_err_ms, round(mx, 3) AS max_abs_err_ms FROM c"""


def timing_jitter(fs: float, tolerance_s: float = 0.05) -> str:
    t = int(tolerance_s * fs)
    return f"SELECT recording_id, method, round(stddev_pop(err), 4) AS jitter_ms, round(MEDIAN(abs(err)), 4) AS median_abs_ms, count(*) AS matched FROM (SELECT recording_id, method, (det - ref) * 1000 / {fs} AS err FROM ({matches(t)}) AS m) AS e GROUP BY recording_id, method"



def unmatched(fs: float, tolerance_s: float = 0.05) -> str:
    """References that no detection of a method has matched, for every method that there is."""
    return f"""
SELECT r.recording_id, r.method, r.idx AS ref
FROM (SELECT recording_id, method, idx FROM (SELECT recording_id, idx, (SELECT VALUES_OF(method) FROM {{d}} AS d2) AS every FROM {{r}} AS r0) AS a, EACH(every, u, method)) AS r
LEFT JOIN ({matches(int(tolerance_s * fs))}) AS m ON r.recording_id = m.recording_id AND r.method = m.method AND r.idx = m.ref
WHERE m.ref IS NULL
"""


#: Pulse rate against heart rate, one row a subject.
PPG_ECG = """
SELECT a.recording_id, round(a.bpm, 1) AS ecg_bpm, round(b.bpm, 1) AS ppg_bpm, round(abs(a.bpm - b.bpm), 1) AS difference, CASE WHEN a.bpm IS NULL OR b.bpm IS NULL THEN NULL ELSE abs(a.bpm - b.bpm) <= 10 END AS agree
FROM {a} AS a JOIN {b} AS b ON a.recording_id = b.recording_id
"""

PERTURBATION = """
SELECT a.recording_id, round(a.amplitude, 6) AS amplitude_before, round(b.amplitude, 6) AS amplitude_after, round(b.noise_rms - a.noise_rms, 6) AS noise_change, round(b.snr_db - a.snr_db, 6) AS snr_change, round(b.score - a.score, 6) AS score_change, a.quality AS quality_before, b.quality AS quality_after
FROM {a} AS a JOIN {b} AS b ON a.recording_id = b.recording_id
"""


def gather(fs: float, lo_s: float, hi_s: float) -> str:
    """Samples [peak + lo, peak + hi) of every peak, by an equi-join on sample numbers."""
    lo, hi = round(lo_s * fs), round(hi_s * fs) - 1
    return f"SELECT p.recording_id, p.idx AS peak, o, v FROM (SELECT recording_id, idx, o FROM {{p}} AS p0, SEQ({lo}, {hi}, u, o)) AS p JOIN {{s}} AS s ON p.recording_id = s.recording_id AND p.idx + p.o = s.idx"


def qrs_amplitude(fs: float = 360.0) -> str:
    return f"SELECT recording_id, count(*) AS beats, round(avg(pp), 6) AS mean_pp, round(stddev_pop(pp), 6) AS std_pp, round(stddev_pop(pp) / NULLIF(avg(pp), 0), 6) AS cv FROM (SELECT recording_id, peak, max(v) - min(v) AS pp FROM ({gather(fs, -0.06, 0.06)}) AS g GROUP BY recording_id, peak) AS h GROUP BY recording_id"


def qrs_width(fs: float = 360.0) -> str:
    """Samples above half of the window's peak-to-peak height; three beats are needed."""
    return f"""
SELECT recording_id, count(*) AS beats, round(avg(width), 6) AS mean_width_ms, round(stddev_pop(width), 6) AS std_width_ms, round(100 * stddev_pop(width) / NULLIF(avg(width), 0), 4) AS variation_pct
FROM (SELECT recording_id, peak, sum(CASE WHEN v - lo > 0.5 * (hi - lo) THEN 1 ELSE 0 END) * 1000 / {fs} AS width FROM (SELECT *, min(v) OVER (PARTITION BY recording_id, peak) AS lo, max(v) OVER (PARTITION BY recording_id, peak) AS hi FROM ({gather(fs, -0.06, 0.06)}) AS g) AS h GROUP BY recording_id, peak) AS i
GROUP BY recording_id HAVING count(*) >= 3
"""


def st_level(fs: float = 360.0) -> str:
    return f"""
SELECT a.recording_id, count(*) AS beats, round(avg(st - iso), 6) AS mean_st, round(stddev_pop(st - iso), 6) AS std_st
FROM (SELECT recording_id, peak, MEDIAN(v) AS st FROM ({gather(fs, 0.08, 0.12)}) AS g GROUP BY recording_id, peak) AS a
JOIN (SELECT recording_id AS rid, peak AS pk, MEDIAN(v) AS iso FROM ({gather(fs, -0.10, -0.06)}) AS h GROUP BY recording_id, peak) AS b ON a.recording_id = rid AND a.peak = pk
GROUP BY a.recording_id
"""


def morphology(fs: float = 360.0) -> str:
    """Likeness of each beat before (``s``) and after (``f``) a filter."""
    after = gather(fs, -0.06, 0.06).replace("{s}", "{f}")
    return f"""
SELECT recording_id, count(*) AS beats, round(MEDIAN(ppb), 5) AS amplitude_before, round(MEDIAN(ppa), 5) AS amplitude_after, round(least(100.0, 100 * MEDIAN(ppa) / NULLIF(MEDIAN(ppb), 0)), 3) AS preserved_pct, round(avg(r), 5) AS mean_correlation, round((least(1.0, greatest(0.0, avg(r))) + least(1.0, MEDIAN(ppa) / NULLIF(MEDIAN(ppb), 0))) / 2, 5) AS score
FROM (SELECT b.recording_id, b.peak, corr(b.v, a.v) AS r, max(b.v) - min(b.v) AS ppb, max(a.v) - min(a.v) AS ppa FROM ({gather(fs, -0.06, 0.06)}) AS b JOIN ({after}) AS a ON b.recording_id = a.recording_id AND b.peak = a.peak AND b.o = a.o GROUP BY b.recording_id, b.peak) AS c
GROUP BY recording_id
"""


#: The same over lists of samples, for DuckDB alone.
MORPHOLOGY_DUCKDB = """
WITH x AS (SELECT recording_id, list(v ORDER BY idx) AS x FROM ({s}) GROUP BY recording_id), y AS (SELECT recording_id, list(v ORDER BY idx) AS y FROM ({f}) GROUP BY recording_id),
near AS (SELECT recording_id, idx AS peak, greatest(1, idx + 1 + {lo}) AS a, idx + 1 + {hi} AS z, x, y FROM ({p}) JOIN x USING (recording_id) JOIN y USING (recording_id)),
pair AS (SELECT recording_id, peak, unnest(x[a:z]) AS b, unnest(y[a:z]) AS c FROM near),
beat AS (SELECT recording_id, corr(b, c) AS r, max(b) - min(b) AS before, max(c) - min(c) AS after FROM pair GROUP BY recording_id, peak),
fact AS (SELECT recording_id, count(*) AS beats, quantile_cont(before, 0.5) AS before, quantile_cont(after, 0.5) AS after, avg(r) AS r FROM beat GROUP BY recording_id)
SELECT recording_id, beats, round(before, 5) AS amplitude_before, round(after, 5) AS amplitude_after, round(least(100.0, 100 * after / nullif(before, 0)), 3) AS preserved_pct, round(r, 5) AS mean_correlation,
       round((least(1.0, greatest(0.0, r)) + least(1.0, after / nullif(before, 0))) / 2, 5) AS score FROM fact
"""


def morphology_oracle(p: str, f: str, s: str, fs: float = 360.0) -> str:
    reach = round(0.06 * fs)
    return MORPHOLOGY_DUCKDB.replace("{lo}", str(-reach)).replace("{hi}", str(reach - 1)).replace("{p}", p).replace("{f}", f).replace("{s}", s)
