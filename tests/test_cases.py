"""Hand-made cases of matching, alerts, modular rhythm and the peak kernels."""

import time

import numpy as np
import pytest

from pulseframe.functions import dsp
from pulseframe.operators import _sql, intervals, matching


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- matching -------------------------------------------------------------------


def metrics(spark, det, ref, fs=100.0, tolerance_s=0.05):
    d = spark.createDataFrame([("a", "m", i) for i in det], "recording_id string, method string, idx long")
    r = spark.createDataFrame([("a", i) for i in ref], "recording_id string, idx long")
    return rows(_sql.run(matching.match_metrics(fs, tolerance_s), d=d, r=r), "tp", "fp", "fn", "recall", "mean_abs_err_ms")


@pytest.mark.parametrize(
    "det,ref,want",
    [
        ([100, 100], [100], (1, 1, 0, 1.0, 0.0)),  # the same detection twice
        ([100, 100, 101], [100, 102], (1, 2, 1, 0.5, 0.0)),  # the first has the reference, the others go without
        ([50, 150, 250], [100, 200, 300, 400, 500], (0, 3, 5, 0.0, None)),
        ([98, 101, 207], [100, 200, 205], (2, 1, 1, 0.6667, 20.0)),
        ([], [100], None),
    ],
)
def test_counts(spark, det, ref, want):
    assert metrics(spark, det, ref) == ([want] if want else [])


def test_tolerance_under_a_sample(spark):
    assert metrics(spark, [10, 21], [10, 20], 12.0, 0.05) == [(1, 1, 1, 0.5, 0.0)]


# --- alerts ---------------------------------------------------------------------


def test_alerts_without_quality(spark):
    """A flagged recording of unknown quality is an alarm, neither limited nor suppressed."""
    p = spark.createDataFrame([(k, 40 * i, 100.0) for k in "abcd" for i in range(8)], "recording_id string, idx long, fs double")
    g = spark.createDataFrame([("a", True, False, False, False), ("b", False, True, False, False), ("c", True, False, False, False), ("d", True, False, False, False)], "recording_id string, possible_vt boolean, possible_vf boolean, vt_evidence boolean, vf_evidence boolean")
    q = spark.createDataFrame([("c", True, True, 0.2, 60.0), ("d", False, False, None, None)], "recording_id string, poor boolean, severe boolean, reliability double, duration_s double")
    got = rows(_sql.run(intervals.ALERT_SUPPRESSION, p=p, g=g, q=q), "recording_id", "priority", "suppressed", "requires_review", "latency_s")
    assert got == [("a", "HIGH", False, False, 1.6), ("b", "CRITICAL", False, False, 1.6), ("c", "MEDIUM", False, True, 1.6), ("d", "HIGH", False, False, 1.6)]
    assert rows(_sql.run(intervals.ALERT_ROLLUP, p=p, g=g, q=q), "priority", "alerts") == [("CRITICAL", 1), ("HIGH", 2), ("MEDIUM", 1)]


# --- modular rhythm -------------------------------------------------------------

WILD = np.cumsum([0, 30, 110, 45, 90, 25, 130, 60, 35, 100, 75, 20, 120, 50, 85, 28]).tolist()
FAST = [38 * i for i in range(12)]
EVEN = [80 * i for i in range(10)]


def modular(spark, cases):
    p = spark.createDataFrame([(k, i, 100.0) for k, (beats, _) in cases.items() for i in beats], "recording_id string, idx long, fs double")
    w = spark.createDataFrame([(k, *f) for k, (_, f) in cases.items() if f], "recording_id string, amplitude_cv double, quality string, severity string")
    return {r.recording_id: r for r in _sql.run(intervals.RHYTHM_MODULAR, p=p, w=w).collect()}


def test_modular_labels(spark):
    got = modular(
        spark,
        {
            "fibrillation": (WILD, (0.8, "GOOD", "CLEAN")),
            "irregular only": (WILD, (0.1, "GOOD", "CLEAN")),
            "unknown wave": (WILD, None),
            "tachycardia": (FAST, (0.1, "GOOD", "CLEAN")),
            "poor at high rate": (FAST, (0.1, "POOR", "CLEAN")),
            "normal": (EVEN, (0.1, "GOOD", "CLEAN")),
            "few": (EVEN[:5], (0.1, "GOOD", "CLEAN")),
            "muscle": (EVEN, (0.1, "GOOD", "SEVERE EMG")),
            "some muscle": (EVEN, (0.1, "GOOD", "MODERATE EMG")),
            "all against": (EVEN[:5], (0.1, "CRITICAL", "SEVERE EMG")),
            "three beats": (EVEN[:3], (0.9, "POOR", "CLEAN")),
        },
    )
    assert got["fibrillation"].label == "Possible Ventricular Fibrillation" and got["fibrillation"].vf_score == 0.7
    assert got["irregular only"].label != "Possible Ventricular Fibrillation" and got["irregular only"].vf_score == 0.5 and got["irregular only"].possible_vf
    assert got["unknown wave"].vf_score == 0.5
    assert got["tachycardia"].label == "Possible Ventricular Tachycardia" and got["tachycardia"].vt_score == 1.0 and not got["tachycardia"].possible_vf
    assert got["poor at high rate"].vf_score == 0.1 and got["poor at high rate"].possible_vf
    assert [got[k].confidence_score for k in ("normal", "few", "muscle", "some muscle", "all against")] == [1.0, 0.8, 0.65, 0.85, 0.2]
    assert (got["three beats"].label, got["three beats"].confidence_score, got["three beats"].confidence, got["three beats"].possible_vf) == ("Unknown / Unclassifiable", 0.0, "UNRELIABLE", False)


# --- kernels --------------------------------------------------------------------


def prominence(x, p):
    def floor(side):
        low = x[p]
        for v in side:
            if v > x[p]:
                break
            low = min(low, v)
        return low

    return x[p] - max(floor(x[p::-1]), floor(x[p:]))


def test_prominence():
    r = np.random.default_rng(5)
    for k in range(200):
        x = r.integers(0, int(r.integers(2, 9)), int(r.integers(3, 70))).astype(float) if k % 2 else r.normal(size=60)
        every = dsp.find_peaks(x)
        for least in (0.0, 1.0, 2.5):
            assert dsp.find_peaks(x, prominence=least).tolist() == [p for p in every.tolist() if prominence(x, p) >= least]


def test_peaks_of_a_long_wave_take_linear_time():
    r = np.random.default_rng(6)

    def seconds(x):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            dsp.find_peaks(x, distance=98, prominence=0.3 * x.std())
            best = min(best, time.perf_counter() - began)
        return best

    for x in (np.sin(np.arange(400_000) * 0.02) + 0.3 * r.normal(size=400_000), np.cumsum(r.normal(size=400_000)), np.arange(400_000) * 1e-3 + r.normal(size=400_000)):
        assert seconds(x) < 1.0  # 0.2 s on an idle machine


def test_third_detector_takes_the_gradient():
    r = np.random.default_rng(7)
    x = r.normal(size=900)
    slope = [x[1] - x[0], *[(x[i + 1] - x[i - 1]) / 2 for i in range(1, 899)], x[899] - x[898]]
    energy = [g * g + v * v for g, v in zip(slope, x, strict=True)]
    w = 18
    mean = np.array([np.mean(energy[max(0, i - w + 1) : i + 1]) for i in range(900)])
    want = dsp.find_peaks(mean, height=0.5 * np.percentile(mean, 75), distance=72)
    assert dsp.christov(x, 360.0).tolist() == want.tolist()
