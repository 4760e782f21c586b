"""Registered queries of the signal engine, with their DuckDB counterparts.

A ``Sql`` entry has one text for both engines; inputs are signal sources, which
nest other texts.  The other entries are DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import _sql, display, folds, intervals, matching, quality, samples, spectral
from ..sources import signals

TABLES = ("region", "events", "lineitem", "nation", "supplier", "customer", "orders", "embeddings")

#: Segments and detectors of the event series take a nominal 36 Hz, so that recordings have many segments.
FS = 36.0
CHANNELS = "SELECT event_type AS recording_id, CAST(user_id % 3 AS INT) AS channel, value AS v FROM {events}"
SYNTH_PEAKS = f"SELECT recording_id, idx, 360.0 AS fs FROM ({intervals.local_maxima(0.6).replace('{s}', f'({signals.SYNTH})')}) AS x1"
EVENT_PEAKS = f"SELECT recording_id, idx, 12.0 AS fs FROM ({intervals.local_maxima(0.3).replace('{s}', f'({signals.EVENTS})')}) AS x2"
PEAKS = f"SELECT * FROM ({SYNTH_PEAKS}) AS y1 UNION ALL SELECT * FROM ({EVENT_PEAKS}) AS y2"
#: A stated quality, as the monitor would give it, of most recordings.
STATED = f"SELECT recording_id, length(recording_id) % 2 = 0 AS poor, length(recording_id) % 3 = 0 AS severe, 0.1 * (length(recording_id) % 10) AS reliability, span AS duration_s FROM (SELECT recording_id, (max(idx) + 1) / max(fs) AS span FROM ({PEAKS}) AS pk GROUP BY recording_id) AS st WHERE length(recording_id) <> 6"
#: Stated facts of every recording's wave, and of a few that have no beats; none lies on a threshold, where 0.1 as a decimal and as a double differ.
WAVES = f"SELECT recording_id, CASE WHEN length(recording_id) = 5 THEN 4.0 ELSE span END AS seconds, 0.05 + 0.1 * (length(recording_id) % 8) AS amplitude_cv, CASE WHEN length(recording_id) % 7 <> 0 THEN 0.05 + 0.1 * (length(recording_id) % 9) END AS wave_entropy, CASE length(recording_id) % 4 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'POOR' ELSE 'CRITICAL' END AS quality, CASE length(recording_id) % 3 WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'MODERATE EMG' ELSE 'SEVERE EMG' END AS severity FROM (SELECT recording_id, (max(idx) + 1) / max(fs) AS span FROM ({PEAKS}) AS wp GROUP BY recording_id UNION ALL SELECT r_name AS recording_id, 30.0 AS span FROM {{region}}) AS wq"
#: The modular classifier's flags; a few state no evidence, as an outside monitor's may not.
FLAGS = f"SELECT recording_id, possible_vt, possible_vf, possible_vt AND length(recording_id) % 5 <> 2 AS vt_evidence, possible_vf AND length(recording_id) % 5 <> 2 AS vf_evidence FROM ({intervals.RHYTHM_MODULAR}) AS fl".replace("{w}", f"({WAVES})")
PROFILES = "SELECT n_name AS recording_id, CASE n_nationkey % 5 WHEN 0 THEN 'SEVERE EMG' WHEN 1 THEN 'MODERATE EMG' WHEN 2 THEN 'MILD EMG' ELSE 'CLEAN' END AS emg_severity, (n_nationkey % 7) / 10.0 AS baseline, n_nationkey % 4 * 6 AS motion, n_nationkey % 3 = 0 AS powerline, n_nationkey % 6 = 5 AS saturated FROM {nation}"
SEGMENT_EMG = "SELECT CAST(s_nationkey AS VARCHAR(20)) AS recording_id, CASE s_suppkey % 4 WHEN 3 THEN 'SEVERE EMG' WHEN 2 THEN 'MODERATE EMG' WHEN 1 THEN 'MILD EMG' ELSE 'CLEAN' END AS emg_severity FROM {supplier}"
TRUTH = f"SELECT recording_id, beat * period AS idx FROM ({signals.SYNTH}) AS tr WHERE beat * period < 3000 AND beat >= 0 GROUP BY recording_id, beat, period"
METHODS = f"SELECT recording_id, 'maxima' AS method, idx FROM ({SYNTH_PEAKS}) AS a1 UNION ALL SELECT recording_id, 'late' AS method, idx + 7 AS idx FROM ({SYNTH_PEAKS}) AS a2 UNION ALL SELECT recording_id, 'sparse' AS method, idx + 25 AS idx FROM ({SYNTH_PEAKS}) AS a3 WHERE idx % 2 = 0 AND length(recording_id) % 2 = 0 UNION ALL SELECT recording_id, 'maxima' AS method, idx FROM ({EVENT_PEAKS}) AS a4"
SMOOTH = f"SELECT recording_id, idx, m AS v FROM ({samples.moving_mean(5).replace('{s}', f'({signals.SYNTH})')}) AS sm"
#: The same wave for the oracle, from its definition: five neighbours, those beyond an end being that end.
SMOOTH_DUCKDB = f"SELECT recording_id, idx, ({' + '.join(f'coalesce({way}(v, {k}) OVER o, {end}(v) OVER w)' for way, end in (('lag', 'first_value'), ('lead', 'last_value')) for k in (1, 2))} + v) / 5 AS v FROM ({signals.SYNTH}) AS sd WINDOW o AS (PARTITION BY recording_id ORDER BY idx), w AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
HALVES = "SELECT event_type AS recording_id, count(*) * 60.0 / (max(event_id) - min(event_id) + 1) AS bpm FROM {events} WHERE event_id % 2 = {k} GROUP BY event_type"
PERTURBED = f"SELECT recording_id, idx, v + 0.5 * sin(0.2 * idx) AS v FROM ({signals.EVENTS}) AS pe"


@dataclass
class Sql:
    text: str
    inputs: dict[str, str] = field(default_factory=dict)

    def whole(self) -> str:
        text = self.text
        for name, source in self.inputs.items():
            text = text.replace("{" + name + "}", f"({source})")
        return text

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        text = self.whole()
        used = {t: signals.table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
        return spark.sql(_sql.render(text, "spark"), **used)

    def duckdb(self) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", _sql.render(self.whole(), "duckdb"))


#: Series numbered by day: for operators that work within a recording in parallel.
EP, GP = {"s": signals.EVENTS_SPLIT}, {"s": signals.GAPS_SPLIT}
E, G, S = {"s": signals.EVENTS}, {"s": signals.GAPS}, {"s": signals.SYNTH}
P = {"p": PEAKS}

SQL: dict[str, Sql] = {
    # sample-wise
    "gap_fill_linear": Sql(samples.GAP_FILL, GP),
    "missing_profile": Sql(samples.MISSING_PROFILE, GP),
    "baseline_moving_mean": Sql(samples.baseline(FS), EP),
    "ppg_baseline": Sql(samples.baseline(FS, 1.5), EP),
    "detrend": Sql(samples.detrend(FS), EP),
    "adaptive_detrend": Sql(samples.adaptive_detrend(10.0), {"s": signals.ORDERS}),
    "removed_component": Sql(samples.removed_component(FS), EP),
    "central_derivative": Sql(samples.central_derivative(FS), EP),
    "squared_energy": Sql(samples.squared_energy(FS), EP),
    "mwi_trailing": Sql(samples.mwi_trailing(FS), EP),
    "rms_envelope": Sql(samples.rms_envelope(FS), EP),
    "burst_fraction": Sql(samples.burst_fraction(FS), EP),
    "forward_fill_trace": Sql(samples.FORWARD_FILL, GP),
    "minmax_decimate": Sql(samples.decimate(400), EP),
    "time_crop": Sql(samples.crop(5.0, 15.0, FS), EP),
    "channel_select": Sql(samples.channel_select(5), {"s": CHANNELS}),
    "step_differences": Sql(samples.step_differences(FS), E),
    # quality
    "signal_quality": Sql(quality.SIGNAL_QUALITY, G),
    "snr_proxy": Sql(quality.SNR_PROXY, E),
    "robust_amplitude": Sql(quality.ROBUST_AMPLITUDE, E),
    "noise_rms": Sql(quality.NOISE_RMS, E),
    "muscle_steps": Sql(quality.MUSCLE_STEPS, E),
    "saturation": Sql(quality.SATURATION, E),
    "flatline": Sql(quality.FLATLINE, E),
    "quality_overall": Sql(quality.QUALITY_OVERALL, G),
    "segment_stats": Sql(quality.segment_stats(FS), GP),
    "segment_status": Sql(quality.segment_status(FS), G),
    "segment_noise_ratio": Sql(quality.segment_noise_ratio(FS), E),
    "segment_saturation": Sql(quality.segment_saturation(FS), EP),
    "segment_flatline": Sql(quality.segment_flatline(FS), EP),
    "amplitude_jump": Sql(quality.amplitude_jump(FS), E),
    "status_rollup": Sql(quality.status_rollup(FS), G),
    "hist_entropy": Sql(quality.hist_entropy(), E),
    "segment_kl_shift": Sql(quality.segment_kl_shift(FS), E),
    "segment_drift": Sql(quality.segment_drift(FS), G),
    "noise_type_vote": Sql(quality.noise_type_vote(), {"s": PROFILES}),
    "dominant_emg": Sql(quality.DOMINANT_EMG, {"s": SEGMENT_EMG}),
    # peaks, intervals, rules
    "local_maxima": Sql(intervals.local_maxima(0.3), E),
    "synthetic_peaks": Sql(intervals.local_maxima(0.6), S),
    "rr_intervals": Sql(intervals.RR_INTERVALS, P),
    "hr_series": Sql(intervals.HR_SERIES, P),
    "interval_tiles": Sql(intervals.INTERVAL_TILES, P),
    "longest_run": Sql(intervals.LONGEST_RUN, P),
    "first_rapid_run_latency": Sql(intervals.FIRST_RUN_LATENCY, P),
    "rr_features": Sql(intervals.RR_FEATURES, P),
    "vt_evidence": Sql(intervals.VT_EVIDENCE, P),
    "vf_evidence": Sql(intervals.VF_EVIDENCE, P),
    "rhythm_label": Sql(intervals.RHYTHM_LABEL, P),
    "rhythm_batch": Sql(intervals.RHYTHM_BATCH, P | {"w": WAVES}),
    "rhythm_modular": Sql(intervals.RHYTHM_MODULAR, P | {"w": WAVES}),
    "alert_suppression": Sql(intervals.ALERT_SUPPRESSION, P | {"q": STATED, "g": FLAGS.replace("{p}", f"({PEAKS})")}),
    "alert_rollup": Sql(intervals.ALERT_ROLLUP, P | {"q": STATED, "g": FLAGS.replace("{p}", f"({PEAKS})")}),
    # matching and morphology
    "peak_match_metrics": Sql(matching.match_metrics(360.0), {"d": METHODS, "r": TRUTH}),
    "unmatched_references": Sql(matching.unmatched(360.0), {"d": METHODS, "r": TRUTH}),
    "timing_jitter": Sql(matching.timing_jitter(360.0), {"d": METHODS, "r": TRUTH}),
    "algorithm_compare": Sql(f"SELECT method, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS f1 FROM ({matching.match_metrics(360.0)}) AS mm GROUP BY method", {"d": METHODS, "r": TRUTH}),
    "ppg_ecg_agreement": Sql(matching.PPG_ECG, {"a": HALVES.replace("{k}", "0"), "b": HALVES.replace("{k}", "1")}),
    "perturbation_delta": Sql(matching.PERTURBATION, {"a": quality.SIGNAL_QUALITY.replace("{s}", f"({signals.EVENTS})"), "b": quality.SIGNAL_QUALITY.replace("{s}", f"({PERTURBED})")}),
    "qrs_amplitude": Sql(matching.qrs_amplitude(), {"p": SYNTH_PEAKS, "s": signals.SYNTH}),
    "qrs_width": Sql(matching.qrs_width(), {"p": SYNTH_PEAKS, "s": signals.SYNTH}),
    "st_level": Sql(matching.st_level(), {"p": SYNTH_PEAKS, "s": signals.SYNTH}),
    "morphology_corr": Sql(matching.morphology(), {"p": SYNTH_PEAKS, "f": SMOOTH, "s": signals.SYNTH}),
    # generators
    "sine_wave": Sql(f"SELECT recording_id, idx, round(v, 6) AS v FROM ({signals.SINE}) AS sw", {}),
    "pulse_wave": Sql(f"SELECT recording_id, idx, round(v, 6) AS v FROM ({signals.PULSES}) AS pw", {}),
    # display
    "perturbations": Sql(display.PERTURBATION_FACTS, S),
    "what_changed": Sql(display.what_changed(), {"f": SMOOTH, "s": signals.SYNTH}),
    "detection_reliability": Sql(display.RELIABILITY, {"f": f"SELECT recording_id, cv, beats, n * mean AS span FROM ({intervals.FEATURES}) AS fe", "q": "SELECT DISTINCT recording_id, 0.1 * (length(recording_id) % 10) AS quality, 0.05 * (length(recording_id) % 4) AS emg FROM {p}"} | P),
    "rhythm_match": Sql(display.rhythm_match(), {"l": f"SELECT a.recording_id, a.label, b.label AS reference FROM ({intervals.RHYTHM_LABEL}) AS a JOIN ({intervals.RHYTHM_MODULAR}) AS b ON a.recording_id = b.recording_id"} | P | {"w": WAVES}),
    "motion_label": Sql(display.MOTION, {"s": quality.SIGNAL_QUALITY.replace("{s}", f"({signals.EVENTS})")}),
    # spectra
    "dft_power": Sql(spectral.dft_power(), S),
    "band_fraction": Sql(spectral.band_fraction(), E),
    "spectral_entropy": Sql(spectral.spectral_entropy(), E),
    "powerline_flag": Sql(spectral.powerline(), S),
}

NOISE_SERIES = f"SELECT recording_id, segment AS k, noise AS x FROM ({quality.segments(FS)}) AS ns WHERE noise IS NOT NULL"
CANDIDATES = f"SELECT recording_id, idx, mwi AS w FROM (SELECT recording_id, idx, mwi, lag(mwi) OVER {samples.W} AS pw, lead(mwi) OVER {samples.W} AS nw FROM ({samples.integral(FS)}) AS ci) AS cj WHERE mwi > pw AND mwi > nw"
VALID_RR = f"SELECT recording_id, beat AS k, rr FROM ({intervals.VALID}) AS vr"


def _fold(function: Callable, source: Sql, oracle: Callable, *args):
    return (lambda spark, sf_dir: function(source.spark(spark, sf_dir), *args)), oracle(re.sub(r"\{(\w+)\}", r"\1", _sql.render(source.whole(), "duckdb")), *args)


FOLDS = {
    "cusum_change_points": _fold(folds.cusum, Sql(NOISE_SERIES, E), folds.cusum_oracle, 0.8, 0.5),
    "adaptive_threshold_peaks": _fold(folds.adaptive_threshold, Sql(CANDIDATES, E), folds.adaptive_oracle, int(0.2 * FS)),
    "streaming_vt_fold": _fold(folds.streaming_vt, Sql(VALID_RR, P), folds.streaming_vt_oracle),
}


def _duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", _sql.render(text, "duckdb"))


#: Oracles that say an operator's rules anew, instead of rendering its text.
INDEPENDENT = {
    "peak_match_metrics": matching.metrics_oracle(_duck(METHODS), _duck(TRUTH), 360.0, 0.05),
    "algorithm_compare": matching.metrics_oracle(_duck(METHODS), _duck(TRUTH), 360.0, 0.05, True),
    "alert_suppression": intervals.SUPPRESSION_DUCKDB.replace("{p}", _duck(PEAKS)).replace("{q}", _duck(STATED)).replace("{g}", _duck(FLAGS.replace("{p}", f"({PEAKS})"))),
    "adaptive_detrend": samples.ADAPTIVE_DUCKDB.replace("{w}", str(samples.adaptive_width(10.0))).replace("{s}", _duck(signals.ORDERS)),
    "rhythm_modular": intervals.MODULAR_DUCKDB.replace("{p}", _duck(PEAKS)).replace("{w}", _duck(WAVES)),
    "morphology_corr": matching.morphology_oracle(_duck(SYNTH_PEAKS), _duck(SMOOTH_DUCKDB), _duck(signals.SYNTH)),
    "what_changed": _duck(Sql(display.what_changed(), {"f": SMOOTH_DUCKDB, "s": signals.SYNTH}).whole()),
    "alert_rollup": intervals.ROLLUP_DUCKDB.replace("{p}", _duck(PEAKS)).replace("{q}", _duck(STATED)).replace("{g}", _duck(FLAGS.replace("{p}", f"({PEAKS})"))),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import kernels

    found: dict[str, Callable] = {name: q.spark for name, q in SQL.items()}
    found |= {name: f for name, (f, _) in FOLDS.items()}
    return found | kernels.queries()


def oracle_sql() -> dict[str, str]:
    from . import kernels

    return kernels.oracle_sql() | {name: q.duckdb() for name, q in SQL.items()} | {name: sql for name, (_, sql) in FOLDS.items()} | INDEPENDENT
