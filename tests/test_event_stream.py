"""The chunk stream in event time: late, lost and idle recordings, restart from the checkpoint, facts of the run."""

import datetime as dt
import json
import time

import numpy as np
import pytest

from pulseframe.streaming import edge, facts

FS, SIZE = 360.0, 720
SCHEMA = "recording_id string, idx long, v double, ts timestamp"
BEGAN = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def wave(n, every=150):
    return sum(np.exp(-(((np.arange(n) - c) / 9) ** 2)) for c in range(100, n, every))


def rows(name, x, idx=None, shift=0.0):
    idx = range(len(x)) if idx is None else idx
    return [{"recording_id": name, "idx": i, "v": float(x[i]), "ts": (BEGAN + dt.timedelta(seconds=i / FS + shift)).isoformat()} for i in idx]


class Source:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()

    def add(self, *parts):
        self.n += 1
        time.sleep(0.02)  # files are read in the order of their times
        (self.folder / "in" / f"{self.n}.json").write_text("\n".join(json.dumps(r) for p in parts for r in p))

    def run(self, **options):
        """All files that have come since the last run, one a micro-batch; state and progress come from the checkpoint."""
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))
        q = edge.stream_events(stream, FS, **options).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "ck")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(150) and q.exception() is None

    def out(self):
        return self.spark.read.parquet(str(self.folder / "out"))


COLUMNS = ["recording_id", "chunk_index", "start_sample", "n_samples", "peaks", "heart_rate_bpm", "vt_alert"]


def plain(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_late_lost_and_idle(spark, tmp_path):
    a, b, c = wave(2160), wave(1000, 170), wave(5000, 190)
    s = Source(spark, tmp_path)
    progress = facts.Progress()
    spark.streams.addListener(progress)
    try:
        s.add(rows("a", a, range(900)), rows("b", b, [i for i in range(1000) if i != 300]))  # b loses a sample, and then falls silent
        s.add(rows("a", a, range(1000, 2160)))
        s.add(rows("a", a, [*range(900, 1000), 3, 4], shift=4.0))  # out of order, and two that come too late
        s.run(idle_s=20.0, lateness="5 seconds")
        first = s.out().count()
        s.add(rows("c", c, range(2500), shift=100.0))  # a hundred seconds on: a and b are idle
        s.add(rows("c", c, range(2500, 5000), shift=100.0))
        s.add(rows("d", c, range(100)))  # older than the watermark
        s.run(idle_s=20.0, lateness="5 seconds")
        for _ in range(100):
            if progress.late and progress.rows >= 900 + 999 + 1160 + 102 + 5000:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    out = s.out()
    late = out.filter("kind = 'late'").collect()
    assert [(r.recording_id, sorted(r.late_idx), r.late_samples) for r in late] == [("a", [3, 4], 2)]
    assert out.filter("recording_id = 'd'").count() == 0
    found = progress.facts()
    assert found["late_rows"] >= 1 and found["rows"] >= 8000 and found["max_batch_ms"] >= found["mean_batch_ms"] > 0 and found["batches"] >= 6
    # the rows equal the batch over the same samples; the lost one is missing there, too
    table = [(r["recording_id"], r["idx"], r["v"]) for r in rows("a", a) + rows("c", c)] + [("b", i, None if i == 300 else float(v)) for i, v in enumerate(b)]
    want = edge.batch(spark.createDataFrame(table, "recording_id string, idx long, v double"), FS)
    got = out.filter("kind <> 'late'")
    closed = {r.recording_id for r in out.filter("kind = 'tail'").collect()}
    assert "b" in closed and first < out.count()
    assert plain(got.filter("recording_id IN ('a', 'b')")) == plain(want.filter("recording_id IN ('a', 'b')"))
    have = {r[1] for r in plain(got.filter("recording_id = 'c'"))}
    assert plain(got.filter("recording_id = 'c'")) == [r for r in plain(want.filter("recording_id = 'c'")) if r[1] in have] and len(have) >= 6


def test_restart_keeps_the_intervals(spark, tmp_path):
    """A stream that is stopped after every file gives what an unbroken one gives, the last intervals included."""
    x = wave(9 * SIZE, 130)
    cuts = [range(k * 2 * SIZE, min(len(x), (k + 1) * 2 * SIZE)) for k in range(5)]
    broken, whole = tmp_path / "a", tmp_path / "b"
    broken.mkdir()
    whole.mkdir()
    one, two = Source(spark, broken), Source(spark, whole)
    for c in cuts:
        two.add(rows("a", x, c))
    two.run(idle_s=1000.0)
    for c in cuts:
        one.add(rows("a", x, c))
        one.run(idle_s=1000.0)
    key = lambda r: r.chunk_index
    got, want = sorted(one.out().collect(), key=key), sorted(two.out().collect(), key=key)
    assert [r.asDict() for r in got] == [r.asDict() for r in want] and len(got) == 9
    peaks = [p for r in got for p in r.peaks]
    assert got[-1].recent_rr == pytest.approx([d / FS for d in np.diff(peaks)][-edge.RECENT :]) and len(got[-1].recent_rr) == edge.RECENT


def test_states_expire(spark, tmp_path):
    """With a time to live the state of a silent recording goes: what it sends later begins anew."""
    (tmp_path / "in").mkdir()
    schema = "recording_id string, idx long, v double"
    x = wave(1000)
    part = lambda r: "\n".join(json.dumps({"recording_id": "a", "idx": i, "v": float(x[i])}) for i in r)
    stream = lambda: edge.stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), FS, ttl_s=1.0)
    q = stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="500 milliseconds").start()

    def taken(n):
        for _ in range(300):
            if sum(p["numInputRows"] for p in q.recentProgress) >= n:
                return True
            time.sleep(0.1)

    try:
        (tmp_path / "in" / "1.json").write_text(part(range(400)))
        assert taken(400)
        time.sleep(2.5)
        (tmp_path / "in" / "2.json").write_text(part(range(400, 1000)))
        assert taken(1000)
    finally:
        q.stop()
    assert spark.read.schema(edge.CHUNK).parquet(str(tmp_path / "out")).count() == 0  # 600 samples wait; with the first 400 they would have been a chunk


def test_observed_facts(spark):
    x = wave(3000)
    signal = spark.createDataFrame([(k, i, float(v)) for k in "ab" for i, v in enumerate(x)], "recording_id string, idx long, v double")
    chunks, seen = facts.observe(edge.batch(signal, FS, timed=True), FS)
    got = chunks.collect()
    found = facts.report(seen.get)
    assert found["samples"] == 6000 and found["chunks"] == len(got) == 10 and found["duration_s"] == pytest.approx(6000 / FS)
    assert found["max_chunk_ms"] == max(r.elapsed_ms for r in got) and found["mean_chunk_ms"] == pytest.approx(np.mean([r.elapsed_ms for r in got]))
    assert found["samples_per_s"] == pytest.approx(6000 / found["processing_s"]) and found["realtime_ratio"] > 0 and found["latency_target_met"] in (True, False)
    empty, none = facts.observe(edge.batch(signal.limit(0), FS, timed=True), FS, "none")
    empty.collect()
    assert facts.report(none.get)["samples_per_s"] is None
