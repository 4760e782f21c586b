"""Rules over sets, against the same rules over one recording."""

import duckdb
import numpy as np
import pytest

from pulseframe.functions import dsp
from pulseframe.operators import _sql, intervals
from pulseframe.plans import oracles, pipelines

FS = 360.0


def wave_facts(wave, peaks):
    w = int(0.06 * FS)
    amps = np.array([np.ptp(wave[max(0, p - w) : p + w]) for p in peaks])
    return float(amps.std() / amps.mean()) if len(amps) > 1 else 0.0, dsp.spectral_entropy(wave, FS)


@pytest.fixture(scope="module")
def cases():
    rng, found = np.random.default_rng(3), {}
    t = np.arange(7200)
    sine, noise = np.sin(t / 20), rng.normal(size=7200)
    swing = sine * np.where(t // 400 % 2, 3.0, 0.2)
    steady, ragged = np.arange(100, 7000, 144), np.unique(np.cumsum(rng.integers(80, 1000, 40)))
    ragged = ragged[ragged < 7000]
    for name, peaks in {"steady": steady, "slow": np.arange(100, 7000, 460), "normal": np.arange(100, 7000, 300), "ragged": ragged, "few": np.array([50, 400, 900]), "sparse": np.array([10, 2000, 4100, 6900]), "none": np.zeros(0, int), "apart": np.array([10, 3000, 6000, 7000]), "rare": np.array([10, 1000, 1990, 2980])}.items():
        for kind, wave in (("sine", sine), ("noise", noise), ("swing", swing)):
            for quality, severity in (("GOOD", "CLEAN"), ("POOR", "SEVERE EMG"), ("CRITICAL", "MODERATE EMG")):
                found[f"{name} {kind} {quality}"] = (peaks, wave, quality, severity)
    found["short"] = (np.arange(100, 1500, 144), sine[:1600], "GOOD", "CLEAN")
    found["no entropy"] = (np.arange(0, 700, 100), sine[:719], "CRITICAL", "CLEAN")
    return found


def test_batch_rhythm_is_that_of_one_recording(spark, cases):
    beats = [(k, int(p), FS) for k, (peaks, *_) in cases.items() for p in peaks]
    facts = [(k, len(w) / FS, *wave_facts(w, peaks), quality, severity) for k, (peaks, w, quality, severity) in cases.items()]
    p = spark.createDataFrame(beats, "recording_id string, idx long, fs double")
    w = spark.createDataFrame(facts, "recording_id string, seconds double, amplitude_cv double, wave_entropy double, quality string, severity string")
    got = {r.recording_id: r for r in _sql.run(intervals.RHYTHM_BATCH, p=p, w=w).collect()}
    assert set(got) == set(cases)
    for name, (peaks, wave, quality, severity) in cases.items():
        want = pipelines.rhythm(peaks, wave, FS, quality, severity, len(wave) / FS)
        assert (got[name].label, got[name].possible_vt, got[name].possible_vf, got[name].confidence) == (want["rhythm_label"], want["possible_vt"], want["possible_vf"], want["rhythm_confidence"]), name
        assert got[name].confidence_score == pytest.approx(want["rhythm_confidence_score"], abs=1e-4), name
    labels = {r.label for r in got.values()}
    assert {"Possible Ventricular Fibrillation", "Possible Ventricular Tachycardia", "Sinus Bradycardia", "Normal Sinus Rhythm", "Unknown / Unclassifiable", "Recording Too Short for Rhythm Analysis"} <= labels


def test_peak_oracle_and_kernel_agree_on_plateaus_and_ties(spark):
    rng = np.random.default_rng(8)
    waves = {f"w{k}": np.round(rng.normal(size=n) * 2) for k, n in enumerate((3, 40, 200, 400))} | {"flat": np.zeros(50), "two": np.array([1.0, 2.0])}
    data = [(k, i, float(x)) for k, w in waves.items() for i, x in enumerate(w)]
    values = ", ".join(f"('{k}', {i}, {x!r})" for k, i, x in data)
    signal = f"SELECT * FROM (VALUES {values}) AS t(recording_id, idx, v)"
    df = spark.createDataFrame(data, "recording_id string, idx long, v double")
    for height, distance, prominence in ((None, 1, None), (1.0, 1, None), (0.0, 5, None), (None, 7, 3.0)):
        sql = oracles.peaks(signal, height, distance, "" if prominence is None else f"max({prominence!r})")
        got = sorted(tuple(r) for r in pipelines.local_peaks(df, height, distance, prominence).collect())
        assert got == sorted(duckdb.sql(sql).fetchall()) and got


def test_lab_compares_with_the_clean_copy(spark):
    n = 3600
    x = sum(np.exp(-(((np.arange(n) - c) / 9) ** 2)) for c in range(150, n, 300))
    df = spark.createDataFrame([("a:b", k, float(v)) for k, v in enumerate(x)], "recording_id string, idx long, v double")
    got = {r.kind: r for r in pipelines.perturbation_lab(df).collect()}
    clean = pipelines.run_ecg(x, FS)
    assert set(got) == {"baseline", "powerline", "powerline60", "inverted", "missing", "patch", "saturated", "emg", "motion", "combined"}
    for r in got.values():
        assert r.recording_id == "a:b" and r.beats_before == clean["n_beats"] and r.quality_before == clean["signal_quality"]
        assert r.reliability_before == pytest.approx(clean["detection_reliability"], abs=1e-6)
    assert got["emg"].emg_severity_after == "SEVERE EMG" and got["emg"].score_after < got["emg"].score_before
    assert got["baseline"].beats_after == clean["n_beats"]
