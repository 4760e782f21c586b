"""Operators within one recording in parallel, against the whole recording at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import dsp
from pulseframe.operators import _sql, longrun, samples, spectral
from pulseframe.sources import signals

BAND = dsp.butter(4, 0.5, 45.0, 360.0)


def wave(n, seed=0):
    r = np.random.default_rng(seed)
    return np.sin(np.arange(n) * 0.03) + r.normal(size=n)


def frame(spark, data):
    rows = [(k, i, None if v is None or v != v else float(v)) for k, x in data.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id string, idx long, v double").repartition(3)


def lists(df, *columns):
    out = {}
    for r in df.orderBy("recording_id", "idx").collect():
        out.setdefault(r.recording_id, []).append([r[c] for c in columns] if len(columns) > 1 else r[columns[0]])
    return out


# --- filters --------------------------------------------------------------------


@pytest.mark.parametrize("sos", [BAND, dsp.notch(50.0, 30.0, 360.0), dsp.butter(2, 0.05, 40.0, 360.0)])
@pytest.mark.parametrize("size,fan", [(64, 4096), (100, 3)])
def test_zero_phase(spark, sos, size, fan):
    data = {"a": wave(1711), "b": wave(100, 1), "c": wave(101, 2), "d": wave(20, 3), "e": wave(205, 4), "f": wave(1, 5), "g": wave(28, 6)}
    got = lists(longrun.zero_phase(frame(spark, data), sos, size, fan), "v")
    assert got.keys() == data.keys()
    for k, x in data.items():
        assert np.abs(np.array(got[k]) - dsp.zero_phase(sos, x)).max() < 3e-9, k  # rounding adds up over chunks as short as these


def test_causal(spark):
    data = {"a": wave(903), "b": wave(64, 1), "c": wave(1, 2)}
    got = lists(longrun.causal(frame(spark, data), BAND, 64, 4), "v")
    for k, x in data.items():
        assert np.abs(np.array(got[k]) - dsp.sos_filter(BAND, x, dsp.sos_state(BAND) * x[0])[0]).max() < 1e-9


def test_a_million_samples(spark):
    n = 1_000_000
    sig = spark.range(0, n, 1, 8).select(F.lit("a").alias("recording_id"), F.col("id").alias("idx"), (F.sin(F.col("id") * 0.03) + F.pmod(F.hash("id"), F.lit(1000)) / 500).alias("v"))
    x = sig.orderBy("idx").toPandas()["v"].to_numpy()
    out = longrun.zero_phase(sig, BAND).withColumn("task", F.spark_partition_id()).toPandas().sort_values("idx")
    assert np.abs(out["v"].to_numpy() - dsp.zero_phase(BAND, x)).max() < 1e-9
    assert out["task"].nunique() > 1


def test_missing_samples_and_nothing(spark):
    x = wave(300)
    holes = [None if i in (0, 70, 71, 299) else v for i, v in enumerate(x)]
    zeros = np.array([0.0 if v is None else v for v in holes])
    assert np.abs(np.array(lists(longrun.zero_phase(frame(spark, {"a": holes}), BAND, 64), "v")["a"]) - dsp.zero_phase(BAND, zeros)).max() < 1e-9
    assert longrun.zero_phase(frame(spark, {}), BAND, 64).count() == 0
    with pytest.raises(ValueError):
        longrun.zero_phase(frame(spark, {"a": x}), BAND, 10)


# --- windows and scans ----------------------------------------------------------

LENGTHS = {"a": 1, "b": 2, "c": 40, "d": 1023, "e": 1024, "f": 1025, "g": 3100}


@pytest.fixture(scope="module")
def data():
    return {k: np.round(10 * wave(n, ord(k)), 3) for k, n in LENGTHS.items()}


@pytest.mark.parametrize("window,left", [(5, None), (217, None), (36, 18), (1501, None)])
def test_moving_mean(spark, data, window, left):
    got = lists(_sql.run(samples.moving_mean(window, left), s=frame(spark, data)), "m")
    for k, x in data.items():
        assert np.allclose(got[k], dsp.moving_mean(x, window), atol=1e-7, rtol=0), k


def test_derivative_and_integral(spark, data):
    long = {k: x for k, x in data.items() if len(x) > 2}
    d = lists(_sql.run(samples.derivative(360.0), s=frame(spark, long)), "d")
    m = lists(_sql.run(samples.integral(360.0), s=frame(spark, long)), "mwi")
    for k, x in long.items():
        assert np.allclose(d[k], dsp.derivative(x, 360.0), rtol=1e-12, atol=1e-9), k
        assert np.allclose(m[k], dsp.trailing_mean(dsp.derivative(x, 360.0) ** 2, 54), atol=1e-3, rtol=1e-9), k


def test_rms(spark, data):
    got = lists(_sql.run(samples.rms(360.0), s=frame(spark, data)), "rms")
    for k, x in data.items():
        assert np.allclose(got[k], np.sqrt(dsp.moving_mean(x * x, 36)), atol=1e-5), k


def test_gaps_over_parts(spark, data):
    holed = {k: x.copy() for k, x in data.items()}
    holed["g"][[0, 1, 5]] = holed["g"][1000:2900] = holed["g"][3090:] = np.nan
    holed["e"][:-1] = np.nan
    holed["f"][:] = np.nan
    holed["d"][500:] = np.nan
    filled = lists(_sql.run(samples.GAP_FILL, s=frame(spark, holed)), "v")
    forward = lists(_sql.run(samples.FORWARD_FILL, s=frame(spark, holed)), "v")
    for k, x in holed.items():
        assert np.allclose(filled[k], dsp.fill_gaps(x), atol=1e-6), k
        last, want = 0.0, []
        for v in x:
            last = last if v != v else v
            want.append(last)
        assert np.allclose(forward[k], want, atol=1e-6), k


def test_numbering_by_day_and_tasks(spark, sf_dir):
    """Series are numbered as before, and work within them is spread over more tasks than there are series."""
    events = {"events": signals.table(spark, sf_dir, "events")}
    for split, plain in ((signals.EVENTS_SPLIT, signals.EVENTS), (signals.GAPS_SPLIT, signals.GAPS)):
        a, b = (sorted(map(str, _sql.run(t, **events).collect())) for t in (split, plain))
        assert a == b
    long = spark.range(60_000).selectExpr("concat('r', id % 5) AS recording_id", "id div 5 AS idx", "id % 77 * 1.0 AS v")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for text in (samples.GAP_FILL, samples.baseline(), samples.mwi_trailing(), samples.FORWARD_FILL, samples.central_derivative(), samples.rms_envelope(), samples.decimate(4000)):
            tasks = _sql.run(text, s=long).withColumn("t", F.spark_partition_id()).toPandas()["t"].nunique()  # all columns, so that no window is pruned
            assert tasks > 10, text
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# --- spectra --------------------------------------------------------------------


@pytest.mark.parametrize("nperseg", [256, 512, 2048])
def test_two_stage_spectra(spark, nperseg):
    """Long, short and odd recordings against the transform of the kernel."""
    data = {"long": wave(5000) + np.sin(np.arange(5000) * 0.8727), "just": wave(nperseg, 1), "short": wave(101, 2), "even": wave(100, 3), "one": wave(1, 4), "flat": np.full(300, 2.0)}
    got = {}
    for r in _sql.run(spectral.welch(360.0, nperseg), s=frame(spark, data)).collect():
        got.setdefault(r.recording_id, {})[r.k] = (r.freq, r.p)
    assert got["long"].keys() == set(range(nperseg // 2 + 1))
    for name in ("long", "just", "short", "even", "flat"):
        freqs, p = dsp.welch(data[name], 360.0, nperseg)
        assert np.allclose([got[name][k][0] for k in range(len(freqs))], freqs) and np.allclose([got[name][k][1] for k in range(len(p))], p, rtol=1e-9, atol=1e-12), name


def test_mains_tones_are_told(spark, sf_dir):
    """Recordings with a planted tone are flagged at 50 Hz, the others aren't."""
    from pulseframe.plans import catalogue

    found = {(r.recording_id, r.mains_hz): r.powerline for r in catalogue.queries()["mains_tones"](spark, sf_dir).collect()}
    keys = {r.n_name: r.n_nationkey for r in signals.table(spark, sf_dir, "nation").collect()}
    assert all(found[n, 50] == (k % 2 == 1) for n, k in keys.items()) and not any(v for (_, hz), v in found.items() if hz == 60)


def test_long_spectra_are_dealt_by_their_length(spark):
    """So many samples a partition, however few partitions the session has; equal results."""
    data = {"long": wave(5000), "short": wave(101, 2), "one": wave(1, 4)}
    got, want = ({(r.recording_id, r.k): (r.freq, r.p) for r in df.collect()} for df in (spectral.spread(frame(spark, data), each=500), _sql.run(spectral.welch(), s=frame(spark, data))))
    assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k][1], rel=1e-9) if want[k][1] is not None else got[k][1] is None for k in want)
    plan = spectral.spread(frame(spark, data), each=500)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x and ", 11)" in x]) == 1, plan


# --- adaptive detrending --------------------------------------------------------


@pytest.mark.parametrize("fs", [10.0, 360.0, 2000.0])
def test_adaptive_detrending(spark, fs):
    """Recordings about the window's and a part's length, with gaps, against the lists of its definition."""
    w = samples.adaptive_width(fs)
    lengths = {1, 2, 3, 4, 5, w - 1, w, w + 1, 1023, 1024, 1025, 1024 + w // 2, w + 1024, 2 * w + 2500}
    data = {f"r{n}": [None if i % 7 == 5 else round(float(x), 3) for i, x in enumerate(wave(n, n))] for n in lengths} | {"none": [None] * 3, "odd": [None, 4.0], "gap": [1.0, None, 2.0, 5.0]}
    got = lists(_sql.run(samples.adaptive_detrend(fs), s=frame(spark, data)), "v")
    assert got.keys() == data.keys()
    for k, x in data.items():
        n, known = len(x), [v for v in x if v is not None]
        width = min(w, n - 1)
        y = np.array([v or 0.0 for v in x])
        if width < 3:
            m = [np.median(known) if known else np.nan] * n
        else:
            y = np.concatenate([[y[0]] * (width // 2), y, [y[-1]] * (width - 1 - width // 2)])
            m = np.convolve(y, np.ones(width), "valid") / width
        assert [v is None for v in got[k]] == [v is None for v in x], k
        assert np.allclose([v for v in got[k] if v is not None], [v - u for v, u in zip(x, m, strict=True) if v is not None], atol=2e-6), k


def test_adaptive_detrending_reads_once(spark):
    plan = _sql.run(samples.adaptive_detrend(10.0), s=spark.range(100).selectExpr("'a' AS recording_id", "id AS idx", "1D AS v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Join" not in plan
