"""Kernels against their definitions."""

import numpy as np
import pytest

from pulseframe.functions import dsp
from pulseframe.plans import pipelines

FS = 360.0


def gain(sos, f, fs=FS):
    z = np.exp(-2j * np.pi * f / fs)
    return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos]))


def ecg(bpm=70, seconds=20, fs=FS, noise=0.02, seed=0):
    n, period = int(seconds * fs), 60 / bpm * fs
    i, beats = np.arange(n), np.arange(period / 2, n, period)
    x = sum(np.exp(-(((i - c) / 9) ** 2)) for c in beats)
    return x + noise * np.random.default_rng(seed).normal(size=n), beats


@pytest.mark.parametrize(("order", "lo", "hi"), [(4, 0.5, 45), (2, 0.05, 40), (3, 0.5, 8), (4, 20, None), (2, None, 80)])
def test_butterworth_is_3_db_down_at_its_edges(order, lo, hi):
    sos = dsp.butter(order, lo, hi, FS)
    for f in (lo, hi):
        if f is not None:
            assert 20 * np.log10(gain(sos, f)) == pytest.approx(-3.0103, abs=0.01)
    inside = np.sqrt(lo * hi) if lo and hi else (lo or 1) * 3 if lo else hi / 10
    assert gain(sos, inside) == pytest.approx(1, abs=0.02)


def test_notch_takes_one_frequency():
    sos = dsp.notch(50.0, 30.0, FS)
    assert gain(sos, 50.0) < 1e-9
    assert gain(sos, 40.0) == pytest.approx(1, abs=0.05)


def test_zero_phase_does_not_shift():
    t = np.arange(3600) / FS
    x = np.sin(2 * np.pi * 5 * t)
    assert np.corrcoef(x, dsp.bandpass(x, (0.5, 45), 4, FS))[0, 1] > 0.99
    assert np.std(dsp.bandpass(np.sin(2 * np.pi * 150 * t), (0.5, 45), 4, FS)[400:-400]) < 0.05


def test_causal_filter_in_pieces_is_the_whole():
    sos, x = dsp.butter(4, 0.5, 45, FS), np.random.default_rng(1).normal(size=1000)
    whole, _ = dsp.sos_filter(sos, x)
    a, state = dsp.sos_filter(sos, x[:333])
    b, _ = dsp.sos_filter(sos, x[333:], state)
    assert np.allclose(np.r_[a, b], whole)


@pytest.mark.parametrize("sos", [dsp.butter(4, 0.5, 45, FS), dsp.butter(2, 0.05, 40, FS), dsp.butter(2, None, 80, FS), dsp.notch(50.0, 30.0, FS)])
def test_filtering_by_blocks_is_filtering_by_samples(sos):
    x, start = np.random.default_rng(2).normal(size=5003), np.random.default_rng(3).normal(size=(len(sos), 2))
    for a, b in zip(dsp.sos_filter(sos, x, start), dsp._by_sample(sos, x, start), strict=True):
        assert np.allclose(a, b, rtol=0, atol=1e-8)


def test_searchback_looks_a_whole_window_past_the_refractory_time():
    """A weak beat 0.5 s after its predecessor: past 0.36 s, within 0.2 s + 0.36 s."""
    n = 7200
    beats = [c for c in range(200, n, 200)]
    missed = beats[17]
    x = sum((0.42 if c == missed else 1.0) * np.exp(-(((np.arange(n) - c) / 6) ** 2)) for c in beats)
    plain, found = dsp.detect_beats(x, FS, searchback=False), dsp.detect_beats(x, FS)
    near = lambda p: np.abs(p - missed).min() < 40
    assert not near(plain) and near(found)
    mwi = dsp.trailing_mean(dsp.derivative(x, FS) ** 2, 54)
    assert dsp.search_again(x, mwi, plain, FS) == []  # 0.42 squared is less than 0.4 of the greatest
    again = dsp.search_again(x, mwi, np.delete(plain, 5), FS)
    assert len(again) == 1 and abs(again[0] - beats[5]) < 40


def test_welch_finds_a_tone_and_its_power():
    t = np.arange(7200) / FS
    f, p = dsp.welch(2 * np.sin(2 * np.pi * 45 * t), FS, 512)
    assert f[p.argmax()] == pytest.approx(45, abs=FS / 512)
    assert p.sum() * (f[1] - f[0]) == pytest.approx(2, rel=0.02)


def test_find_peaks_by_hand():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 5, 0], float)
    assert dsp.find_peaks(x).tolist() == [1, 4, 7, 9]
    assert dsp.find_peaks(x, height=2.5).tolist() == [4, 9]
    assert dsp.find_peaks(x, distance=3).tolist() == [1, 4, 9]
    assert dsp.find_peaks(x, prominence=2.5).tolist() == [4, 9]


@pytest.mark.parametrize("bpm", [50, 70, 100, 140])
def test_beats_of_a_known_rate(bpm):
    x, beats = ecg(bpm)
    found = dsp.detect_beats(dsp.bandpass(x - dsp.baseline(x, FS), (0.5, 45), 4, FS), FS)
    assert abs(len(found) - len(beats)) <= 2
    assert 60 / np.median(np.diff(found)) * FS == pytest.approx(bpm, rel=0.03)
    assert np.diff(found).min() >= 0.15 * FS


def test_inverted_wave_has_the_same_beats():
    x, beats = ecg(70)
    up, down = (len(pipelines.run_ecg(v, FS)["r_peaks"]) for v in (x, -x))
    assert abs(up - down) <= 3


def test_gaps_flat_and_repeat():
    x, _ = ecg(70)
    holes = x.copy()
    holes[200:250] = np.nan
    assert pipelines.run_ecg(holes, FS) == pipelines.run_ecg(holes, FS)
    assert pipelines.run_ecg(np.zeros(1000), FS)["signal_quality"] == "CRITICAL"
    assert np.allclose(dsp.fill_gaps(np.array([np.nan, 1, np.nan, 3, np.nan])), [1, 1, 2, 3, 3])


def test_rhythms():
    assert pipelines.run_ecg(ecg(72)[0], FS)["rhythm_label"] == "Normal Sinus Rhythm"
    assert pipelines.run_ecg(ecg(50)[0], FS)["rhythm_label"] == "Sinus Bradycardia"
    assert pipelines.run_ecg(ecg(150, 25)[0], FS)["rhythm_label"] not in ("Normal Sinus Rhythm", "Sinus Bradycardia")
    steady = pipelines.rhythm(np.arange(0, 7200, 144), np.sin(np.arange(7200) / 20), FS, "GOOD", "CLEAN", 20.0)
    assert steady["possible_vt"] and steady["rhythm_confidence"] == "HIGH" and len(steady["vt_evidence"]) == 5
    assert pipelines.latency(np.array([0.8, 0.4, 0.4, 0.6, 0.4, 0.4, 0.4, 0.4])) == pytest.approx(1.6)
    assert pipelines.latency(np.array([0.4, 0.4, 0.4])) is None
    assert pipelines.run_ecg(ecg(72, 4)[0], FS)["rhythm_label"] == "Recording Too Short for Rhythm Analysis"


def test_pulse_and_muscle():
    t = np.arange(int(15 * FS)) / FS
    ppg = pipelines.run_ppg(0.5 * np.sin(2 * np.pi * 1.2 * t) + 0.1 * np.sin(4 * np.pi * 1.2 * t), FS)
    assert ppg["pulse_rate_bpm"] == pytest.approx(72, abs=2)
    emg = pipelines.run_emg(0.5 * np.random.default_rng(0).normal(size=3600), FS)
    assert emg["emg_severity"] == "SEVERE EMG" and 0 <= emg["burst_fraction"] < 0.3


def test_pulses_are_also_beats():
    t = np.arange(int(15 * FS)) / FS
    x = 0.5 * np.sin(2 * np.pi * 1.2 * t)
    got = pipelines.run_ppg(x, FS)
    assert got["n_beats"] == len(got["pulse_peaks"]) > 10 and got["heart_rate_bpm"] == got["pulse_rate_bpm"] and got["heart_rate_reliable"]
    assert (got["signal_quality"], got["pulse_quality"]) == ("GOOD", "GOOD")
    flat = pipelines.run_ppg(np.ones(1000), FS)
    assert (flat["signal_quality"], flat["pulse_quality"], flat["n_beats"], flat["heart_rate_bpm"]) == ("CRITICAL", "FLATLINE", 0, None)


def test_noise_is_named_by_muscle_then_drift():
    assert [pipelines.noise_kind(s, 0.9) for s in ("SEVERE EMG", "MODERATE EMG", "MILD EMG", "CLEAN")] == ["EMG contamination", "EMG contamination", "Mild EMG / noise", "Baseline wander"]
    assert [pipelines.noise_kind("CLEAN", v) for v in (0.40, 0.15, 0.41, 0.16)] == ["Mild baseline wander", "Clean", "Baseline wander", "Mild baseline wander"]


def test_reliability_counts_long_gaps():
    assert pipelines.reliability(np.full(9, 0.8), 1.0, 0.0) == pytest.approx(1.0)
    assert pipelines.reliability(np.full(9, 0.8), 0.6, 0.1) == pytest.approx(0.3 + 0.5 - 0.2)
    rr = np.r_[np.full(9, 0.8), 8.0]
    assert pipelines.reliability(rr, 1.0, 0.0) == pytest.approx(0.5 + 0.5 * max(0, 1 - 2 * rr.std() / rr.mean()))
    assert pipelines.reliability(np.zeros(0), 1.0, 0.0) == 0.0


def test_morphology_by_hand():
    n, peaks = 2000, np.arange(200, 1900, 300)
    x = np.zeros(n)
    for p in peaks:
        x[p], x[p - 1], x[p + 1] = 2.0, 1.0, 1.0
        x[p + 28 : p + 42] = 0.3  # the ST segment: 80 ms after the beat, 40 ms long
        x[p - 35 : p - 21] = 0.1  # the rest before it
    got = pipelines.morphology(x, 0.5 * x, peaks, FS)
    assert (got["qrs_amplitude_before"], got["qrs_amplitude_after"]) == (2.0, 1.0)
    assert (got["st_level_before"], got["st_level_after"]) == (pytest.approx(0.2), pytest.approx(0.05))
    assert got["morphology_score"] == pytest.approx((0.5 + 1) / 2)
    assert pipelines.morphology(x, x, peaks[:2], FS)["morphology_score"] is None


def test_batch_results_come_from_the_stated_waves():
    x, _ = ecg(72)
    got = pipelines.run_ecg(x, FS)
    flat = x - dsp.baseline(x, FS)
    assert got["warnings"] == [] and got["noise_type"] in ("Clean", "Mild baseline wander", "Baseline wander")
    assert got["snr_proxy_after_db"] == pytest.approx(dsp.snr_proxy(dsp.bandpass(flat, (0.05, 40.0), 2, FS)))
    assert all(0.2 <= v <= 3 for v in got["rr_intervals_s"])
    short = pipelines.run_ecg(x[:600], FS)
    assert short["powerline_50hz"] is False and short["emg_energy_ratio"] == pytest.approx(dsp.emg(x[:600], *dsp.welch(x[:600], FS, 512), FS)[0])
    hum = pipelines.run_ecg(x + 0.5 * np.sin(2 * np.pi * 50 * np.arange(len(x)) / FS), FS)
    assert hum["powerline_50hz"] and "50 Hz notch applied." in hum["warnings"]
