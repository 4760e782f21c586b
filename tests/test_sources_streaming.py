"""Sources, validation, matching by hand, and the stream against the batch."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import _sql, intervals, matching
from pulseframe.plans import pipelines
from pulseframe.sources import files, signals
from pulseframe.streaming import edge


def texts(spark, *bodies):
    return spark.createDataFrame([(str(k), b) for k, b in enumerate(bodies)], "recording_id string, text string")


def test_text_forms(spark):
    df = files.parse_text(texts(spark, "1\n2\nnan\n4", "time,ecg\n0.0,1\n0.1,NA\n# no\n\n0.2,3\nbad,row", "time;I;II\n0;1;5\n1;2;6"))
    got = {(r.recording_id, r.channel_name, r.idx): (r.t, r.v) for r in df.collect()}
    assert [got["0", "Ch0", k][1] for k in range(4)] == [1, 2, None, 4]
    assert [got["1", "ecg", k] for k in range(3)] == [(0.0, 1), (0.1, None), (0.2, 3)]
    assert got["2", "II", 1] == (1.0, 6)
    rates = {r.recording_id: r.fs for r in files.infer_rate(df).collect()}
    assert rates == {"0": 360.0, "1": 10.0, "2": 1.0}
    assert {r.channel_name for r in files.select_channel(df.filter("recording_id = '2'"), 9).collect()} == {"II"}


def test_arrays_and_wfdb(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(5.0))
    np.savez(tmp_path / "b.npz", ecg=np.array([[1.0, 2.0], [np.inf, 4.0]]), fs=250)
    (tmp_path / "c.npy").write_bytes(b"junk")
    rows = files.read_arrays(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.recording_id.rsplit("/", 1)[1], []).append(r)
    assert sorted(r.v for r in by["a.npy"]) == [0, 1, 2, 3, 4]
    assert [(r.channel, r.v) for r in sorted(by["b.npz"], key=lambda r: (r.channel, r.idx))] == [(0, 1.0), (0, None), (1, 2.0), (1, 4.0)]
    assert by["c.npy"][0].message
    got = files.decode_wfdb("r", "r 2 100 2\nr.dat 16 100(5) 12 0 0 0 0 MLII\nr.dat 16 200 12 0 0 0 0 V5", np.array([105, 200, 205, 400], "<i2").tobytes())
    assert got[got.channel == 0].v.tolist() == [1, 2] and got[got.channel == 1].v.tolist() == [1, 2]
    packed = files.decode_wfdb("r", "r 2 360 1\nr.dat 212 1 12 0\nr.dat 212 1 12 0", bytes([0xFF, 0x0F, 0x01]))
    assert packed.v.tolist() == [-1, 1]


def test_validation_is_a_row(spark):
    sig = spark.createDataFrame([("a", k, 1.0) for k in range(120)] + [("b", k, None) for k in range(120)] + [("c", 0, 1.0)], "recording_id string, idx long, v double")
    rec = spark.createDataFrame([("a", 50.0), ("b", 50.0), ("c", 50.0), ("d", 10.0), ("e", None)], "recording_id string, fs double")
    got = {r.recording_id: r.valid for r in signals.validate(sig, rec).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False}
    short = signals.validate(sig, rec.withColumn("fs", F.lit(360.0))).filter("recording_id = 'a'").first()
    assert not short.valid and "0.33 s" in short.message
    out = {r.recording_id: r for r in pipelines.process(sig, 360.0).collect()}
    assert out["a"].valid and not out["b"].valid and "100" in out["c"].validation_message
    assert pipelines.process(sig.filter("recording_id = 'a'"), 360.0, "eeg").first().valid is False
    routed = sig.withColumns({"modality": F.when(F.col("recording_id") == "a", "PPG ").otherwise("eeg"), "fs": F.when(F.col("recording_id") == "c", 5.0).otherwise(100.0)})
    out = {r.recording_id: r for r in pipelines.process(routed, metrics=True).collect()}
    assert (out["a"].modality, out["a"].fs, out["a"].valid) == ("ppg", 100.0, True) and out["b"].validation_message == "unsupported modality: eeg" and out["c"].fs == 5.0
    assert all(r.processing_s >= 0 and r.samples_per_s > 0 for r in out.values())


def test_matching_by_hand(spark):
    d = spark.createDataFrame([("r", "m", x) for x in (50, 150, 250)], "recording_id string, method string, idx long")
    r = spark.createDataFrame([("r", x) for x in (100, 200, 300, 400, 500)], "recording_id string, idx long")
    row = _sql.run(matching.match_metrics(1000.0, 0.01), d=d, r=r).first()
    assert (row.tp, row.fp, row.fn) == (0, 3, 5)
    row = _sql.run(matching.match_metrics(1000.0, 0.01), d=d, r=d.drop("method")).first()
    assert (row.tp, row.f1, row.mean_err_ms) == (3, 1.0, 0.0)
    # nothing detected, no references, and one of each
    d = spark.createDataFrame([("a", "m", 100), ("b", "m", 100), ("b", "k", 900)], "recording_id string, method string, idx long")
    r = spark.createDataFrame([("a", 100), ("c", 50), ("c", 90)], "recording_id string, idx long")
    got = {(x.recording_id, x.method): (x.tp, x.fp, x.fn, x.precision_, x.recall, x.f1) for x in _sql.run(matching.match_metrics(1000.0, 0.01), d=d, r=r).collect()}
    assert got == {("a", "m"): (1, 0, 0, 1.0, 1.0, 1.0), ("a", "k"): (0, 0, 1, 0.0, 0.0, 0.0), ("b", "m"): (0, 1, 0, 0.0, 0.0, 0.0), ("b", "k"): (0, 1, 0, 0.0, 0.0, 0.0), ("c", "m"): (0, 0, 2, 0.0, 0.0, 0.0), ("c", "k"): (0, 0, 2, 0.0, 0.0, 0.0)}
    assert {tuple(x) for x in _sql.run(matching.unmatched(1000.0, 0.01), d=d, r=r).collect()} == {("a", "k", 100), ("c", "m", 50), ("c", "m", 90), ("c", "k", 50), ("c", "k", 90)}


def test_alerts_by_hand(spark):
    g = spark.createDataFrame([("vt", True, False, True, False), ("vf", True, True, True, True), ("none", False, False, False, False), ("weak", True, False, False, False), ("limited", False, True, False, False), ("still", True, False, True, False)], "recording_id string, possible_vt boolean, possible_vf boolean, vt_evidence boolean, vf_evidence boolean")
    q = spark.createDataFrame([("vt", False, False, 0.9), ("vf", False, False, 0.9), ("none", True, True, 0.1), ("weak", False, False, 0.2), ("limited", True, True, 0.1), ("still", False, False, 0.1)], "recording_id string, poor boolean, severe boolean, reliability double").withColumn("duration_s", F.lit(1800.0))
    p = spark.createDataFrame([("vt", 100 * k, 100.0) for k in range(8)] + [("vf", 0, 100.0), ("vf", 50, 100.0)], "recording_id string, idx long, fs double")
    got = {r.recording_id: (r.alert_type, r.priority, r.suppressed, r.requires_review, r.latency_s) for r in _sql.run(intervals.ALERT_SUPPRESSION, g=g, q=q, p=p).collect()}
    assert got == {
        "vt": ("Possible Ventricular Tachycardia", "HIGH", False, False, 4.0),
        "vf": ("Possible Ventricular Fibrillation", "CRITICAL", False, False, 0.5),
        "weak": ("Artifact-driven alarm (suppressed)", "SUPPRESSED", True, False, 0.0),
        "limited": ("Quality-limited alert", "MEDIUM", False, True, 0.0),
        "still": ("Possible Ventricular Tachycardia", "HIGH", False, False, 0.0),
    }


def test_chunks_agree_with_whole(spark):
    n = 7200
    x = sum(np.exp(-(((np.arange(n) - c) / 9) ** 2)) for c in range(150, n, 300))
    sig = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "recording_id string, idx long, v double")
    whole = [r.idx for r in pipelines.beats(sig).orderBy("idx").collect()]
    parts = [r.idx for r in pipelines.beats_chunked(sig, 360.0, 8.0, 1.0).orderBy("idx").collect()]
    assert len(set(parts)) == len(parts)
    assert abs(len(whole) - len(parts)) <= 1


def test_stream_equals_batch(spark, tmp_path):
    n = 2160
    x = sum(np.exp(-(((np.arange(n) - c) / 9) ** 2)) for c in range(100, n, 150))
    rows = [{"recording_id": "a", "idx": k, "v": float(v)} for k, v in enumerate(x)]
    src = tmp_path / "in"
    src.mkdir()
    for name, part in (("1", rows[:900]), ("2", rows[1000:]), ("3", rows[900:1000] + rows[:3])):  # out of order, and late ones
        (src / f"{name}.json").write_text("\n".join(map(json.dumps, part)))
    schema = "recording_id string, idx long, v double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = edge.stream(stream, 360.0).writeStream.format("memory").queryName("edge_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    cols = ["chunk_index", "start_sample", "peaks", "heart_rate_bpm", "vt_alert"]
    got = [tuple(r) for r in spark.table("edge_out").select(cols).orderBy("chunk_index").collect()]
    want = [tuple(r) for r in edge.batch(spark.createDataFrame(rows, schema), 360.0).select(cols).orderBy("chunk_index").collect()]
    assert got == want and any(r[4] for r in got)


def test_stream_with_a_hole_and_a_tail(spark, tmp_path):
    import time

    n, size = 2500, 720
    x = sum(np.exp(-(((np.arange(n) - c) / 9) ** 2)) for c in range(100, n, 150))
    rows = [{"recording_id": "a", "idx": k, "v": float(v)} for k, v in enumerate(x)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps(r) for r in rows if r["idx"] != 300))  # one sample is lost
    stream = spark.readStream.schema("recording_id string, idx long, v double").json(str(src))
    q = edge.stream(stream, 360.0, patience_s=1.0, idle_s=3.0).writeStream.format("memory").queryName("edge_tail").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            got = spark.table("edge_tail").select("chunk_index", "start_sample", "n_samples").orderBy("chunk_index").collect()
            if len(got) == 4:
                break
    finally:
        q.stop()
    assert [tuple(r) for r in got] == [(0, 0, size), (1, size, size), (2, 2 * size, size), (3, 3 * size, n - 3 * size)]


def test_buffer_rules():
    b = edge.Buffer(360.0, 100, 50)
    b.add(list(range(5, 100)), [1.0] * 95)
    assert b.due() == []  # samples 0 to 4 may still come
    b.add(list(range(100, 150)), [1.0] * 50)
    assert [r["n_samples"] for r in b.due()] == [100]
    b.add([3], [1.0])
    assert b.late == 1
    b.add(list(range(700, 760)), [2.0] * 60)
    assert [(r["chunk_index"], r["start_sample"]) for r in b.due(True)] == [(1, 100), (7, 700)] and not b.waiting
    again = edge.Buffer(360.0, 100, 50, dict(zip([c.split()[0] for c in edge.STATE.split(", ")], b.dump(), strict=True)))
    assert again.dump() == b.dump()


def test_edge_chunks_by_the_rules_for_one_chunk_at_a_time():
    """The compatible form against a plain writing of a chunk's rules."""
    fs, n = 360.0, 3000
    rng = np.random.default_rng(3)
    x = sum(np.exp(-(((np.arange(n) - c) / 9) ** 2)) for c in range(100, n, 160)) + 0.02 * rng.normal(size=n)
    x[1000:1700] = rng.normal(size=700)
    from pulseframe.functions import dsp

    size, over = 720, 108
    got, e = [], edge.Edge(fs, compat=True)
    for a in range(0, n, size - over):
        got.append(e.step(a, x[a : a + size], over))
    sos, zi, sig, noise, run, active = dsp.butter(4, 0.5, 45.0, fs), None, 0.0, 0.0, 0, False
    for k, a in enumerate(range(0, n, size - over)):
        part = x[a : a + size]
        w = min(len(part) - 1, 216)
        w += w % 2 == 0
        ext = np.concatenate([[part[0]] * (w // 2), part, [part[-1]] * (w // 2)])
        flat = part - np.array([ext[i : i + w].mean() for i in range(len(part))])
        zi = (dsp.sos_state(sos) if zi is None else zi) * (flat[0] if abs(flat[0]) > 1e-12 else 1.0)
        y, zi = dsp._by_sample(sos, flat, zi)
        d = np.gradient(y) * fs
        d[0], d[-1] = d[1], d[-2]
        mwi = np.array([(d[max(0, i - 53) : i + 1] ** 2).mean() for i in range(len(d))])
        peaks = []
        if len(y) >= 144:
            if sig == 0.0:
                sig = mwi[:720][dsp.find_peaks(mwi[:720], distance=72)].mean()
                noise = 0.1 * sig
            limit = noise + 0.25 * (sig - noise)
            for c in dsp.find_peaks(mwi, distance=36):
                if mwi[c] > limit:
                    lo = max(0, c - 14)
                    peaks.append(a + lo + int(np.abs(y[lo : c + 15]).argmax()))
                    sig = 0.125 * mwi[c] + 0.875 * sig
                else:
                    noise = 0.125 * mwi[c] + 0.875 * noise
        peaks = [p for p in peaks if k == 0 or p >= a + over]
        rr = np.diff(peaks) / fs
        rr = rr[(rr >= 0.2) & (rr <= 3)]
        assert got[k]["peaks"] == peaks and got[k]["emg"] == bool(np.diff(y).std() > 2 * y.std())
        assert got[k]["heart_rate_bpm"] == (pytest.approx(60 / np.median(rr)) if len(rr) else None)
        fired = False
        for v in rr:
            run, active = (run + 1, active) if 60 / v >= 120 else (0, False)
            if run >= 4 and not active:
                active = fired = True
                break
        assert got[k]["vt_alert"] == fired


def test_event_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert edge.windows(events).agg(F.sum("n")).first()[0] == events.count()
    assert edge.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_report_lines(spark):
    sig = spark.createDataFrame([("a", k, float(np.sin(k / 9))) for k in range(800)], "recording_id string, idx long, v double")
    text = files.report(pipelines.process(sig)).first().value
    assert text.startswith("Recording: a") and "Pulse rate: unavailable" in text


def test_npz_reader_survives_no_rate():
    buf = io.BytesIO()
    np.savez(buf, x=np.arange(3.0))
    assert files._array_rows("x", buf.getvalue()).v.tolist() == [0, 1, 2]
    assert files._array_rows("x", buf.getvalue()).channel.unique().tolist() == [0]


def test_table_functions(spark):
    from pulseframe.functions import tables

    tables.register(spark)
    n = 3600
    x = sum(np.exp(-(((np.arange(n) - c) / 9) ** 2)) for c in range(150, n, 300))
    spark.createDataFrame([(x.tolist(),)], "v array<double>").createOrReplaceTempView("one_wave")
    assert spark.sql("SELECT p.* FROM one_wave, LATERAL detect_peaks(v, 360.0D) p").count() == 12
    assert spark.sql("SELECT p.* FROM one_wave, LATERAL welch_psd(v, 360.0D, 256) p").count() == 129


def test_wfdb_annotations(spark, tmp_path):
    word = lambda code, value: (code << 10 | value).to_bytes(2, "little")
    long = lambda step: (step >> 16 & 0xFFFF).to_bytes(2, "little") + (step & 0xFFFF).to_bytes(2, "little")
    body = word(28, 18) + word(63, 3) + b"(N\0\0" + word(1, 77) + word(59, 0) + long(70000) + word(5, 0) + word(61, 1023) + word(62, 1) + word(59, 0) + long(-100 & 0xFFFFFFFF) + word(1, 5) + word(60, 3)
    (tmp_path / "r.atr").write_bytes(body + word(0, 0))
    (tmp_path / "cut.atr").write_bytes(body[:12] + b"\x01")
    (tmp_path / "none.atr").write_bytes(word(0, 0))
    (tmp_path / "r.hea").write_text("r 1 360 0")
    got = {}
    for r in files.read_annotations(spark, str(tmp_path)).collect():
        got.setdefault(r.recording_id.rsplit("/", 1)[-1], []).append(tuple(r)[1:])
    assert got["r"] == [(18, "+", 0, 0, 0, "(N", None), (95, "N", 0, 0, 0, None, None), (70095, "V", -1, 1, 0, None, None), (70000, "N", 0, 1, 3, None, None)]
    assert got["cut"] == [(18, "+", 0, 0, 0, "(N", None), (95, "N", 0, 0, 0, None, None), (None, None, None, None, None, None, "file breaks off")]
    assert "none" not in got
