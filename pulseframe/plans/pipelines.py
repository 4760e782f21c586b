"""Recording pipelines: many recordings an Arrow batch, one row of results each.

A recording's samples meet in one task by a single exchange on
``recording_id``, sorted by it; scalar rules on top of the kernels' numbers stay native where
they are set-based (see ``operators``).  Long recordings can be dealt by
``(recording_id, chunk)`` first - see ``beats_chunked``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..functions import dsp
from ..operators import _sql, display
from ..runtime import ship

RESULT = """recording_id string, modality string, fs double, n_samples long, duration_s double, valid boolean, validation_message string, signal_quality string, signal_quality_score double,
noise_type string, emg_severity string, emg_energy_ratio double, powerline_50hz boolean, powerline_60hz boolean, snr_proxy_before_db double, snr_proxy_after_db double, snr_improvement_db double, r_peaks array<long>, n_beats long, rr_intervals_s array<double>,
heart_rate_bpm double, heart_rate_reliable boolean, rhythm_label string, rhythm_confidence string, rhythm_confidence_score double, possible_vt boolean, possible_vf boolean, vt_evidence array<string>, vf_evidence array<string>, detection_latency_s double, latency_target_met boolean,
qrs_amplitude_before double, qrs_amplitude_after double, st_level_before double, st_level_after double, morphology_score double, detection_reliability double, pulse_quality string, pulse_peaks array<long>, pulse_rate_bpm double, inter_pulse_intervals_s array<double>, burst_fraction double, missing_fraction double, warnings array<string>"""
METRICS = ", processing_s double, samples_per_s double, realtime_ratio double"
NAMES = [part.split()[0] for part in RESULT.replace("\n", " ").split(", ")]


def _entropy(rr: np.ndarray) -> float:
    if len(rr) < 4:
        return 0.0
    h = np.histogram(rr, 32)[0] + 1e-9
    p = h / h.sum()
    return float(np.clip(-(p * np.log2(p)).sum() / 5, 0, 1))


def _longest(flags: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(int), 0]))
    return int((edge[1::2] - edge[::2]).max(initial=0))


def rhythm(peaks: np.ndarray, wave: np.ndarray, fs: float, quality: str, severity: str, seconds: float) -> dict:
    """Batch rhythm rules: evidence is gathered first, the label follows from it."""
    out = {"rhythm_label": "Unknown / Unclassifiable", "rhythm_confidence": "UNRELIABLE", "rhythm_confidence_score": 0.0, "possible_vt": False, "possible_vf": False, "vt_evidence": [], "vf_evidence": []}
    if len(peaks) < 4:
        return out
    if 0 < seconds < DEFAULT.min_rhythm_s:
        return out | {"rhythm_label": "Recording Too Short for Rhythm Analysis"}
    rr = np.diff(peaks) / fs
    rr = rr[(rr >= 0.2) & (rr <= 3.0)]
    if len(rr) < 2:
        return out
    cv, hr, steps = rr.std() / rr.mean(), 60 / np.median(rr), np.diff(rr) * 1000
    regular, entropy = float(np.clip(1 - 3 * cv, 0, 1)), _entropy(rr)
    share = _longest(rr < 60 / DEFAULT.vt_bpm) / len(rr)
    rapid = hr >= DEFAULT.vt_bpm
    vt = [
        (rapid, 0.30, f"Rapid rate: {hr:.0f} BPM (>=120)"),
        (rapid and share >= 0.70, 0.25, f"Sustained rapid beats: {share * 100:.0f}%"),
        (rapid and regular >= 0.55, 0.20, f"Regular rhythm (score={regular:.2f})"),
        (rapid and len(peaks) >= 6, 0.15, f"Sustained observation: {len(peaks)} beats detected"),
        (rapid and entropy < 0.35, 0.10, f"Low RR entropy (regular): {entropy:.2f}"),
    ]
    w = int(0.06 * fs)
    amps = np.array([np.ptp(wave[max(0, p - w) : p + w]) for p in peaks if len(wave[max(0, p - w) : p + w])])
    spread = float(amps.std() / max(amps.mean(), 1e-9)) if len(amps) > 1 else 0.0
    noise, rate = dsp.spectral_entropy(wave, fs), len(peaks) / max(seconds, 1.0) * 60
    vf = [
        (entropy > 0.65 and cv > 0.20, 0.25, f"Disorganized RR: entropy={entropy:.2f}, CV={cv:.2f}"),
        (spread > 0.50, 0.20, f"High amplitude variation (CV={spread:.2f})"),
        (noise is not None and noise > 0.60, 0.25, f"High signal spectral entropy: {noise or 0:.2f}"),
        (seconds >= 5 and rate < 20 and quality != "CRITICAL", 0.30, f"Absent organized QRS: only {rate:.0f} detections/min despite non-critical quality"),
    ]
    score = lambda rules: round(sum(s for hit, s, _ in rules if hit), 9)
    say = lambda rules: [text for hit, _, text in rules if hit]
    vt_score, vf_score = score(vt), score(vf)
    if quality == "CRITICAL" and noise is None:
        vf_score = max(0.0, vf_score - 0.40)
    is_vt, is_vf = vt_score >= 0.65, vf_score >= 0.55
    rmssd, pnn50 = (float(np.sqrt((steps**2).mean())), float((np.abs(steps) > 50).mean())) if len(steps) else (0.0, 0.0)
    if is_vf:
        label, conf = "Possible Ventricular Fibrillation", vf_score
    elif is_vt:
        label, conf = "Possible Ventricular Tachycardia", vt_score
    elif cv >= 0.10 and pnn50 >= 0.15 and rmssd > 40 and entropy > 0.4:
        label, conf = "Possible Atrial Fibrillation", float(np.clip(0.5 + 2 * cv, 0.3, 0.85))
    elif hr >= 100 or hr < 60:
        label, conf = ("Sinus Tachycardia" if hr >= 100 else "Sinus Bradycardia"), 0.7 + 0.3 * regular
    elif regular > 0.5:
        label, conf = "Normal Sinus Rhythm", 0.6 + 0.4 * regular
    else:
        label, conf = "Irregular Rhythm", 0.5
    conf -= 0.25 * (quality in ("POOR", "CRITICAL"))
    conf = max(0.0, conf) - (0.35 if "SEVERE" in severity else 0.15 if "MODERATE" in severity else 0.0)
    conf = float(np.clip(conf, 0, 1))
    level = "HIGH" if conf >= 0.70 else "MODERATE" if conf >= 0.45 else "LOW" if conf >= 0.20 else "UNRELIABLE"
    return {"rhythm_label": label, "rhythm_confidence": level, "rhythm_confidence_score": conf, "possible_vt": is_vt, "possible_vf": is_vf, "vt_evidence": say(vt) if is_vt else [], "vf_evidence": say(vf) if is_vf else []}


def latency(rr: np.ndarray) -> float | None:
    """Time of the first four rapid intervals on end."""
    run = np.convolve(rr < 60 / DEFAULT.vt_bpm, np.ones(DEFAULT.vt_beats), "valid") if len(rr) >= DEFAULT.vt_beats else np.zeros(0)
    at = np.flatnonzero(run == DEFAULT.vt_beats)
    return float(rr[at[0] : at[0] + DEFAULT.vt_beats].sum()) if len(at) else None


def quality(x: np.ndarray, missing: float = 0.0) -> tuple[float, str]:
    if x.std() < DEFAULT.flat_std:
        return 0.0, "CRITICAL"
    amp, noise = float(np.subtract(*np.percentile(x, [95, 5]))), float(np.diff(x).std() / math.sqrt(2))
    score = float(np.clip(1 - min(3 * missing, 0.5) - min(2 * noise / max(amp, 1e-9), 0.5), 0, 1))
    return score, "GOOD" if score >= 0.75 else "MODERATE" if score >= 0.5 else "POOR" if score >= 0.25 else "CRITICAL"


def morphology(raw: np.ndarray, out: np.ndarray, peaks: np.ndarray, fs: float, most: int = 60) -> dict:
    """Beat shape before and after filtering, over at most ``most`` evenly spaced beats; both ST levels are above the unfiltered baseline before the beat."""
    samples = lambda seconds: max(1, int(seconds * fs))
    half, delay, width = samples(0.06), samples(0.08), samples(0.04)
    found = dict.fromkeys(("qrs_amplitude_before", "qrs_amplitude_after", "st_level_before", "st_level_after", "morphology_score"))
    peaks = peaks[(peaks >= half) & (peaks < len(raw) - half - delay - width)]
    if len(peaks) < 3:
        return found
    if len(peaks) > most:
        peaks = peaks[np.round(np.linspace(0, len(peaks) - 1, most)).astype(int)]
    before, after = (v[peaks[:, None] + np.arange(-half, half)] for v in (raw, out))
    ppb, ppa = (float(np.median(np.ptp(m, 1))) for m in (before, after))

    def level(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(v)]
        return (total[hi] - total[lo]) / (hi - lo)

    rest = level(raw, np.maximum(0, peaks - half - width), np.maximum(1, peaks - half))
    st_before, st_after = (float((level(v, peaks + delay, peaks + delay + width) - rest).mean()) for v in (raw, out))
    b, a = before - before.mean(1, keepdims=True), after - after.mean(1, keepdims=True)
    size_b, size_a = np.linalg.norm(b, axis=1), np.linalg.norm(a, axis=1)
    clear = (size_b > 1e-9) & (size_a > 1e-9)
    scores = [min(1.0, ppa / ppb)] if ppb > 1e-9 else []
    if clear.any():
        scores.append(float(np.clip(((b * a).sum(1)[clear] / (size_b * size_a)[clear]).clip(-1, 1).mean(), 0, 1)))
    return {"qrs_amplitude_before": ppb, "qrs_amplitude_after": ppa, "st_level_before": st_before, "st_level_after": st_after, "morphology_score": float(np.mean(scores)) if scores else None}


def gain(before: float | None, after: float | None) -> dict:
    return {"snr_proxy_before_db": before, "snr_proxy_after_db": after, "snr_improvement_db": None if before is None or after is None else after - before}


def noise_kind(severity: str, low: float) -> str:
    """Muscle noise first, however mild; then the share of power below 1 Hz."""
    if severity in ("SEVERE EMG", "MODERATE EMG"):
        return "EMG contamination"
    if severity == "MILD EMG":
        return "Mild EMG / noise"
    return "Baseline wander" if low > 0.40 else "Mild baseline wander" if low > 0.15 else "Clean"


def run_ecg(x: np.ndarray, fs: float, c: Config = DEFAULT) -> dict:
    warnings: list[str] = []
    raw = dsp.fill_gaps(x)
    score, level = quality(raw)
    shared = dsp.welch(raw, fs, 2048) if len(raw) >= int(2 * fs) else None  # shorter recordings have a spectrum for each purpose
    p50, p60 = (shared is not None and dsp.powerline(*shared, len(raw), fs, f) for f in (50.0, 60.0))
    ratio, severity = dsp.emg(raw, *(shared or dsp.welch(raw, fs, 512)), fs)
    freqs, p = shared or dsp.welch(raw, fs, 256)
    low = float(p[freqs < 1].sum() / p.sum()) if p.sum() > 0 else 0.0
    wave = raw
    for f, hit in ((50.0, p50), (60.0, p60)):
        if hit:
            wave = dsp.zero_phase(dsp.notch(f, c.notch_q, fs), wave)
            warnings.append(f"{f:.0f} Hz notch applied.")
    if severity in ("SEVERE EMG", "MODERATE EMG"):
        cutoff = 80.0 if severity == "SEVERE EMG" else 100.0
        if fs / 2 > cutoff:
            wave = dsp.zero_phase(dsp.butter(2, None, cutoff, fs), wave)
        warnings.append(f"Adaptive EMG suppression applied ({severity.split()[0]}).")
    wave = wave - dsp.baseline(wave, fs)
    qrs, morph = dsp.bandpass(wave, c.qrs_band, c.qrs_order, fs), dsp.bandpass(wave, c.morph_band, c.morph_order, fs)
    peaks = dsp.detect_beats(qrs, fs)
    rr = np.diff(peaks) / fs
    valid = rr[(rr >= c.rr_min) & (rr <= c.rr_max)]
    out = {"signal_quality": level, "signal_quality_score": score, "noise_type": noise_kind(severity, low), "emg_severity": severity, "emg_energy_ratio": ratio, "powerline_50hz": p50, "powerline_60hz": p60} | gain(dsp.snr_proxy(raw), dsp.snr_proxy(morph))
    out |= {"r_peaks": peaks.tolist(), "n_beats": len(peaks), "rr_intervals_s": valid.tolist(), "heart_rate_bpm": 60 / float(np.median(valid)) if len(valid) else None, "heart_rate_reliable": len(valid) > 0}
    out |= rhythm(peaks, morph, fs, level, severity, len(x) / fs)
    if out["possible_vt"] or out["possible_vf"]:
        out["detection_latency_s"] = (late := latency(valid))
        out["latency_target_met"] = None if late is None else late <= c.latency_target_s
    out |= morphology(raw, morph, peaks, fs)
    return out | {"detection_reliability": reliability(rr, score, ratio), "warnings": warnings}


def reliability(rr: np.ndarray, score: float, ratio: float) -> float:
    """Half the quality, half the regularity of all intervals (not only of the plausible ones), less for muscle noise."""
    rr = rr[rr > 0]
    if not len(rr):
        return 0.0
    regular = np.clip(1 - 2 * rr.std() / rr.mean(), 0, 1)
    return float(np.clip(0.5 * score + 0.5 * regular - np.clip(2 * ratio, 0, 0.5), 0, 1))


def run_ppg(x: np.ndarray, fs: float, c: Config = DEFAULT) -> dict:
    """Pulses; ``pulse_quality`` is the pulse engine's own verdict beside the general one, and the beat columns repeat the pulses."""
    raw = dsp.fill_gaps(x)
    score, level = quality(raw)
    wave = dsp.bandpass(raw - dsp.baseline(raw, fs, 1.5), c.ppg_band, c.ppg_order, fs)
    peaks = dsp.pulse_peaks(wave, fs)
    ipi = np.diff(peaks) / fs
    ipi = ipi[(ipi >= 60 / c.ppg_bpm[1]) & (ipi <= 60 / c.ppg_bpm[0])]
    moved = dsp.kurtosis(np.diff(raw)) > 10
    verdict = "FLATLINE" if raw.std() < 1e-6 else "POOR" if moved or len(peaks) < 2 or not len(ipi) or len(x) < 2 * fs else "GOOD"
    rate = 60 / float(np.median(ipi)) if len(ipi) else None
    out = {"signal_quality": level, "signal_quality_score": score, "pulse_quality": verdict, "pulse_peaks": peaks.tolist(), "inter_pulse_intervals_s": ipi.tolist(), "pulse_rate_bpm": rate, "warnings": []}
    out |= {"r_peaks": peaks.tolist(), "n_beats": len(peaks), "rr_intervals_s": ipi.tolist(), "heart_rate_bpm": rate, "heart_rate_reliable": rate is not None}
    return out | gain(dsp.snr_proxy(raw), dsp.snr_proxy(wave))


def run_emg(x: np.ndarray, fs: float, c: Config = DEFAULT) -> dict:
    raw = dsp.fill_gaps(x)
    wave = dsp.zero_phase(dsp.butter(4, 20.0, None, fs), raw) if fs / 2 > 25 else raw
    rms = np.sqrt(np.maximum(0.0, dsp.moving_mean(wave**2, max(1, int(0.1 * fs)))))
    burst = float((rms > 2 * np.median(rms)).mean())
    ratio, severity = dsp.emg(raw, *dsp.welch(raw, fs, 512), fs)
    return {"signal_quality": "GOOD" if burst < 0.3 else "MODERATE", "signal_quality_score": 1 - burst, "noise_type": "EMG activity", "emg_severity": severity, "emg_energy_ratio": ratio, "burst_fraction": burst, "warnings": [f"EMG burst fraction: {burst * 100:.1f}% of recording."]} | gain(dsp.snr_proxy(raw), dsp.snr_proxy(wave))


def _recordings(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[str | None, dict[str, np.ndarray]]]:
    """Recordings of batches that are sorted by ``recording_id``; one is held at a time."""
    key, parts, begun = None, [], False
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if begun and ids[lo] != key:
                yield key, dict(zip(columns, map(np.concatenate, zip(*parts, strict=True)), strict=True))
                parts = []
            key, begun = ids[lo], True
            parts.append([c[lo:hi] for c in cols])
    if begun:
        yield key, dict(zip(columns, map(np.concatenate, zip(*parts, strict=True)), strict=True))


RUN = {"ecg": run_ecg, "ppg": run_ppg, "emg": run_emg}


def process(signal: DataFrame, fs: float = 360.0, modality: str = "ecg", config: Config = DEFAULT, metrics: bool = False) -> DataFrame:
    """One row of ``RESULT`` for every recording of ``signal(recording_id, idx, v)``; what is invalid says why.

    Where the signal has columns ``modality`` or ``fs``, each recording goes the
    way of its own (its first sample's); ``metrics`` adds what each one took.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(signal.sparkSession)
    schema = T.StructType.fromDDL(RESULT + (METRICS if metrics else ""))
    arrow = to_arrow_schema(schema)

    def row_of(key: str | None, x: np.ndarray, fs: float, modality: str) -> dict:
        kind = str(modality).strip().lower()
        run, finite, message = RUN.get(kind), np.isfinite(x), ""
        if run is None:
            message = f"unsupported modality: {modality}"
        elif not config.fs_min <= fs <= config.fs_max:
            message = f"sampling rate {fs} Hz is outside {config.fs_min:.0f} to {config.fs_max:.0f} Hz"
        elif len(x) < config.min_samples:
            message = f"too short: {len(x)} samples, at least {config.min_samples} are needed"
        elif not finite.any():
            message = "no finite sample"
        row = {"recording_id": key, "modality": kind, "fs": fs, "n_samples": len(x), "duration_s": len(x) / fs if fs > 0 else 0.0, "valid": not message, "validation_message": message or "OK", "missing_fraction": float(1 - finite.mean()) if len(x) else 0.0, "n_beats": 0, "warnings": [message] if message else []}
        return row if message else row | run(np.where(finite, x, np.nan), fs, config)

    own = [c for c in ("modality", "fs") if c in signal.columns]

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, c in _recordings(batches, "v", *own):
            rate = float(c["fs"][0]) if "fs" in c and c["fs"][0] is not None else fs
            began = time.perf_counter()
            row = row_of(key, c["v"].astype(float), rate if rate == rate else 0.0, c["modality"][0] if "modality" in c else modality)
            if metrics:
                took = time.perf_counter() - began
                row |= {"processing_s": took, "samples_per_s": len(c["v"]) / max(took, 1e-9), "realtime_ratio": took / max(row["duration_s"], 1e-9)}
            rows.append(row)
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    dealt = signal.select("recording_id", "idx", "v", *own).repartition("recording_id").sortWithinPartitions("recording_id", "idx")
    return dealt.mapInArrow(all_of, schema)


def perturbation_lab(signal: DataFrame, fs: float = 360.0, modality: str = "ecg") -> DataFrame:
    """What the whole pipeline finds in every recording before and after each perturbation (``display.PERTURBATIONS``).

    All copies go through in one pass; a recording's clean copy then meets the
    others in a window over its few result rows.
    """
    copies = _sql.run(display.PERTURBATIONS, s=signal).withColumn("recording_id", F.concat("kind", F.lit(":"), "recording_id"))
    found = process(copies, fs, modality)
    facts = {"quality": F.col("signal_quality"), "score": F.round("signal_quality_score", 6), "beats": F.col("n_beats"), "rate_bpm": F.round("heart_rate_bpm", 4), "reliability": F.round("detection_reliability", 6), "emg_severity": F.col("emg_severity")}
    cut = F.instr("recording_id", ":")
    rows = found.select(F.expr("substring(recording_id, instr(recording_id, ':') + 1)").alias("recording_id"), F.col("recording_id").substr(F.lit(1), cut - 1).alias("kind"), F.struct(*[c.alias(k) for k, c in facts.items()]).alias("after"))
    both = rows.withColumn("before", F.max(F.when(F.col("kind") == "clean", F.col("after"))).over(Window.partitionBy("recording_id")))
    return both.filter("kind <> 'clean'").select("recording_id", "kind", *[F.col(f"{side}.{k}").alias(f"{k}_{side}") for k in facts for side in ("before", "after")])


def waves(signal: DataFrame, fs: float = 360.0) -> DataFrame:
    """Raw, QRS-path and morphology-path waves in one pass over each recording."""
    ship(signal.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x = dsp.fill_gaps(pdf["v"].to_numpy(float))
        flat = x - dsp.baseline(x, fs)
        return pd.DataFrame({"recording_id": pdf["recording_id"], "idx": pdf["idx"], "raw": x, "qrs": dsp.bandpass(flat, DEFAULT.qrs_band, 4, fs), "morph": dsp.bandpass(flat, DEFAULT.morph_band, 2, fs), "notched": dsp.zero_phase(dsp.notch(50.0, 30.0, fs), x) if fs > 105 else x})

    return signal.groupBy("recording_id").applyInPandas(one, "recording_id string, idx long, raw double, qrs double, morph double, notched double")


def spectra(signal: DataFrame, fs: float = 360.0, nperseg: int = 256) -> DataFrame:
    ship(signal.sparkSession)

    def one(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = dsp.welch(dsp.fill_gaps(pdf.sort_values("idx")["v"].to_numpy(float)), fs, nperseg)
        return pd.DataFrame({"recording_id": key[0], "k": np.arange(len(f)), "freq": f, "p": p})

    return signal.groupBy("recording_id").applyInPandas(one, "recording_id string, k long, freq double, p double")


def beats(signal: DataFrame, fs: float = 360.0, methods: tuple[str, ...] = ("adaptive",)) -> DataFrame:
    """``recording_id, method, idx`` of beats by each detector; one that fails on a recording gives none there."""
    ship(signal.sparkSession)

    def one(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        x = dsp.fill_gaps(pdf.sort_values("idx")["v"].to_numpy(float))
        y = dsp.bandpass(x - dsp.baseline(x, fs), DEFAULT.qrs_band, 4, fs)
        parts = []
        for m in methods:
            try:
                found = dsp.pulse_peaks(y, fs) if m == "pulse" else dsp.DETECTORS[m](y, fs)
            except (ValueError, IndexError):
                found = []
            parts.append(pd.DataFrame({"recording_id": key[0], "method": m, "idx": np.asarray(found, np.int64)}))
        return pd.concat(parts)

    return signal.groupBy("recording_id").applyInPandas(one, "recording_id string, method string, idx long")


def local_peaks(signal: DataFrame, height: float | None = None, distance: int = 1, prominence: float | None = None) -> DataFrame:
    """``recording_id, idx`` of the local maxima that pass the height, then the distance, then the prominence."""
    ship(signal.sparkSession)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, c in _recordings(batches, "v"):
            at = dsp.find_peaks(dsp.fill_gaps(c["v"].astype(float)), height, distance, prominence)
            yield pa.record_batch({"recording_id": pa.array([key] * len(at), pa.string()), "idx": pa.array(at, pa.int64())})

    dealt = signal.select("recording_id", "idx", "v").repartition("recording_id").sortWithinPartitions("recording_id", "idx")
    return dealt.mapInArrow(all_of, "recording_id string, idx long")


def beats_chunked(signal: DataFrame, fs: float = 360.0, chunk_s: float = 60.0, overlap_s: float = 1.0) -> DataFrame:
    """Beats of long recordings: samples are dealt to overlapping chunks, which are worked in parallel; each chunk gives only beats past its overlap."""
    ship(signal.sparkSession)
    n, over = int(chunk_s * fs), int(overlap_s * fs)
    step = n - over
    last = F.floor(F.col("idx") / step)
    chunks = F.filter(F.array(last, last - 1), lambda k: (k >= 0) & (F.col("idx") < k * step + n))

    def one(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(key[1]) * step
        x = dsp.fill_gaps(pdf.sort_values("idx")["v"].to_numpy(float))
        y = dsp.bandpass(x - dsp.baseline(x, fs), DEFAULT.qrs_band, 4, fs) if len(x) > 30 else x
        found = dsp.detect_beats(y, fs)
        if key[1] > 0:
            found = found[found >= over]
        return pd.DataFrame({"recording_id": key[0], "idx": start + found})

    dealt = signal.withColumn("chunk", F.explode(chunks))
    return dealt.groupBy("recording_id", "chunk").applyInPandas(one, "recording_id string, idx long").distinct()


DETAIL = "recording_id string, idx long, t_s double, amplitude double, raw_amplitude double, mwi double, local_noise double, strength double, accepted boolean, refined boolean, refractory_pass boolean, search_back boolean, rr_prev_s double, rr_next_s double, segment long, segment_noise double, segment_reliability double, reject_reason string"


def segment_facts(x: np.ndarray) -> tuple[float, float]:
    """Noise and reliability of a segment: its QRS strength, less for clipping, and halved where samples are missing."""
    ok = x[np.isfinite(x)]
    if len(ok) < 4 or ok.std() < DEFAULT.flat_std:
        return 0.0, 0.0
    noise = float(np.diff(ok).std() / math.sqrt(2))
    p1, p5, p95, p99 = np.percentile(ok, [1, 5, 95, 99])
    strength = float(np.clip((p95 - p5) / (noise * 6 + 1e-9), 0, 1))
    edge = 0.02 * (p99 - p1)
    clipped = float(((ok >= p99 - edge) | (ok <= p1 + edge)).mean()) if p99 - p1 >= 1e-9 else 1.0
    missing = len(ok) < 0.99 * len(x)
    return noise, float(np.clip(strength * (0.5 + 0.5 * (1 - clipped)) * (clipped < 0.05) * (0.5 if missing else 1.0), 0, 1))


def peak_details(signal: DataFrame, fs: float = 360.0) -> DataFrame:
    """Every decision of the adaptive detector: accepted candidates with the intervals to their neighbours, beats found by searching long intervals again, refractory violations, and near misses of the threshold; each with its segment's noise and reliability."""
    ship(signal.sparkSession)
    refractory, w = int(DEFAULT.refractory_s * fs), max(1, int(DEFAULT.mwi_s * fs))
    names = [c.split()[0] for c in DETAIL.split(", ")]

    def one(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pdf.sort_values("idx")["v"].to_numpy(float)
        x = dsp.fill_gaps(raw)
        y = dsp.bandpass(x - dsp.baseline(x, fs), DEFAULT.qrs_band, 4, fs)
        mwi, rows, last = dsp.trailing_mean(dsp.derivative(y, fs) ** 2, w), [], -2 * refractory
        calib = mwi[: max(1, min(int(2 * fs), len(mwi) // 4))]
        first = dsp.find_peaks(calib, distance=refractory)
        signal_level = float(mwi[first].mean()) if len(first) else 0.5 * float(calib.max(initial=0))
        noise_level = 0.1 * signal_level
        reach, size = max(1, int(0.04 * fs)), max(1, int(DEFAULT.segment_s * fs))
        parts = [segment_facts(raw[a : a + size]) for a in range(0, len(raw), size)]

        def largest(c: int) -> int:
            lo = max(0, c - reach)
            return lo + int(np.abs(y[lo : c + reach + 1]).argmax())

        def row(at: int, accepted: bool, free: bool, again: bool, reason: str | None) -> dict:
            floor = float(np.percentile(mwi[max(0, at - 2 * w) : at + 2 * w], 20))
            noise, reliability = parts[at // size]
            return dict(zip(names, (key[0], at, at / fs, float(y[at]), float(x[at]), float(mwi[at]), floor, float(np.clip(mwi[at] / (floor + 1e-9) / 20, 0, 1)), accepted, accepted, free, again, None, None, at // size, noise, reliability, reason), strict=True))

        for c in dsp.find_peaks(mwi, distance=max(1, refractory // 2)).tolist():
            threshold = noise_level + 0.25 * (signal_level - noise_level)
            over, free = bool(mwi[c] > threshold), c - last >= refractory
            at = c
            if over and free:
                at = largest(c)
                last, signal_level = at, 0.125 * float(mwi[c]) + 0.875 * signal_level
            else:
                noise_level = 0.125 * float(mwi[c]) + 0.875 * noise_level
            if over or mwi[c] > 0.5 * threshold:
                rows.append(row(at, over and free, free, False, None if over and free else "Refractory-period violation" if over else "Below adaptive threshold"))
        beats = sorted({r["idx"] for r in rows if r["accepted"]})
        for at in dsp.search_again(y, mwi, np.array(beats, np.int64), fs):
            rows.append(row(at, True, True, True, None))
        beats = sorted({r["idx"] for r in rows if r["accepted"]})
        place = {p: k for k, p in enumerate(beats)}
        for r in rows:
            if r["accepted"]:
                k = place[r["idx"]]
                r["rr_prev_s"] = (beats[k] - beats[k - 1]) / fs if k else None
                r["rr_next_s"] = (beats[k + 1] - beats[k]) / fs if k + 1 < len(beats) else None
        return pd.DataFrame(rows, columns=names)

    return signal.groupBy("recording_id").applyInPandas(one, DETAIL)
