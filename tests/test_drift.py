"""Shares of low power, the status cascade and the findings, against NumPy and hand-made waves."""

import numpy as np
import pytest

from pulseframe.functions import dsp
from pulseframe.operators import _sql, display, quality, spectral

FS = 100.0


def frame(spark, **waves):
    rows = [(k, i, None if x != x else float(x)) for k, w in waves.items() for i, x in enumerate(w)]
    return spark.createDataFrame(rows, "recording_id string, idx long, v double")


def share(x, fs, nperseg):
    x = x[np.isfinite(x)]
    if len(x) < 32:
        return 0.0
    f, p = dsp.welch(x, fs, nperseg)
    return float(p[f < 1].sum() / p.sum()) if p.sum() >= 1e-20 else 0.0


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(3)
    t = np.arange(1501) / FS
    noise = rng.normal(size=len(t))
    holed = np.where(rng.random(len(t)) < 0.1, np.nan, noise + 2 * np.sin(2 * np.pi * 0.5 * t))
    return {"noise": noise, "slow": 3 * np.sin(2 * np.pi * 0.6 * t) + 0.2 * noise, "holed": holed, "flat": np.full(90, 2.0), "short": noise[:31], "odd": noise[:257].cumsum(), "tiny": noise[:33].cumsum(), "none": np.full(40, np.nan)}


@pytest.mark.parametrize("nperseg", [256, 512, 101])
def test_low_share_is_welchs(spark, waves, nperseg):
    got = {r.recording_id: r.low for r in _sql.run(spectral.low_share("0", FS, nperseg), s=frame(spark, **waves)).collect()}
    assert set(got) == set(waves) - {"none"}
    for k, low in got.items():
        assert low == pytest.approx(share(waves[k], FS, nperseg), abs=1e-9), k
    assert got["slow"] > 0.4


def test_status_cascade(spark):
    rng = np.random.default_rng(5)
    n, t = 500, np.arange(500) / FS
    still = rng.normal(size=n)
    drift = np.sin(2 * np.pi * 0.5 * t + 0.3) + 0.05 * rng.normal(size=n)
    gone, flat = np.full(n, np.nan), np.full(n, 1.0)
    wave = {"drift": drift, "shift": np.concatenate([still, np.sign(still) * 0.1 + 1e-3 * still]), "same": np.concatenate([still, still]), "lost": np.concatenate([still, gone, gone]), "level": flat}
    got = {(r.recording_id, r.segment): r for r in _sql.run(quality.segment_status(FS, 5.0), s=frame(spark, **wave)).collect()}
    assert got["drift", 0].status == "Baseline drift increasing"
    assert got["shift", 1].status == "Noise profile changed"
    assert got["same", 1].status == got["same", 0].status != "Noise profile changed"
    # a segment without values has an even histogram: the first differs from what was before, the second doesn't
    assert [got["lost", k].status for k in (1, 2)] == ["Noise profile changed", "Missing data"]
    assert got["level", 0].status == "Flatline" and got["level", 0].reliability == 0


def test_low_finding(spark, waves):
    raw = frame(spark, a=waves["slow"], b=waves["noise"], c=waves["noise"])
    done = frame(spark, a=waves["noise"], b=waves["slow"], c=waves["noise"])
    got = {r.recording_id: r for r in _sql.run(display.what_changed(FS), s=raw, f=done).collect()}
    assert [got[k].low_finding for k in "abc"] == ["baseline wander reduced", "low-frequency content retained", ""]
    assert got["a"].low_before == pytest.approx(share(waves["slow"], FS, 512), abs=1e-5)
