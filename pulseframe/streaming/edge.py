"""Chunk-wise processing with carried state, as a batch fold and as a streaming operator.

Both run the same ``Edge`` on a recording's chunks in order, so a stream and a
batch of the same samples give the same rows.  By default the causal filter and
the interval series go on across chunks; ``compat=True`` instead re-reads an
overlap, scales the carried filter state by each chunk's first sample and lets
intervals end with the chunk.

A chunk's rules: beats are moved to the largest deflection within 40 ms; levels
start from the first chunk's first two seconds; muscle noise is a filtered wave
whose steps vary twice as much as itself; the rate is that of the chunk's own
intervals (by default with the one that reaches back to the beat before it).
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import dsp
from ..runtime import ship

CHUNK = "recording_id string, chunk_index long, start_sample long, n_samples long, peaks array<long>, heart_rate_bpm double, emg boolean, vt_alert boolean, alert_latency_s double, late_samples long"
STATE = "next_sample long, chunk_index long, zi array<double>, spki double, npki double, last_peak long, run long, active boolean, buffer_idx array<long>, buffer_v array<double>, late long"


#: Intervals that a recording's state keeps.
RECENT = 20
EVENT = f"{CHUNK}, kind string, late_idx array<long>, recent_rr array<double>"


class Edge:
    """State of one recording between chunks."""

    def __init__(self, fs: float, compat: bool = False):
        self.fs, self.compat = fs, compat
        self.sos = dsp.butter(4, 0.5, min(45.0, 0.99 * fs / 2), fs)
        self.zi: np.ndarray | None = None
        self.spki = self.npki = 0.0
        self.last, self.run, self.active = -1, 0, False
        self.chunk = 0
        self.recent: list[float] = []  # the last RECENT intervals, however long the recording is

    def dump(self) -> dict:
        return {"zi": [] if self.zi is None else self.zi.ravel().tolist(), "spki": self.spki, "npki": self.npki, "last_peak": self.last, "run": self.run, "active": self.active, "chunk_index": self.chunk}

    def load(self, row: dict) -> None:
        self.zi = np.array(row["zi"], float).reshape(-1, 2) if len(row["zi"]) else None
        self.spki, self.npki, self.last, self.run, self.active = row["spki"], row["npki"], row["last_peak"], row["run"], row["active"]
        self.chunk = row["chunk_index"]

    def step(self, start: int, x: np.ndarray, overlap: int = 0) -> dict:
        out = {"chunk_index": self.chunk, "start_sample": start, "n_samples": len(x), "peaks": [], "heart_rate_bpm": None, "emg": False, "vt_alert": False, "alert_latency_s": None, "late_samples": 0}
        if len(x) < 4:
            self.chunk += 1
            return out
        x = dsp.fill_gaps(np.where(np.isfinite(x), x, np.nan).astype(float))
        flat = x - dsp.baseline(x, self.fs)
        scale = flat[0] if abs(flat[0]) > 1e-12 else 1.0
        if self.zi is None:
            self.zi = dsp.sos_state(self.sos) * scale
        elif self.compat:
            self.zi = self.zi * scale
        y, self.zi = dsp.sos_filter(self.sos, flat, self.zi)
        refractory = int(DEFAULT.refractory_s * self.fs)
        mwi = dsp.trailing_mean(dsp.derivative(y, self.fs) ** 2, max(1, int(DEFAULT.mwi_s * self.fs)))
        top = dsp.find_peaks(mwi, distance=max(1, refractory // 2)) if len(y) >= 2 * refractory else np.zeros(0, np.int64)
        if self.spki < 1e-12 and self.npki < 1e-12 and len(y) >= 2 * refractory:
            calib = mwi[: int(DEFAULT.calibration_s * self.fs)]
            first = dsp.find_peaks(calib, distance=max(1, refractory))
            self.spki = float(calib[first].mean()) if len(first) else float(mwi.max()) * 0.5 + 1e-12
            self.npki = 0.1 * self.spki
        threshold = self.npki + 0.25 * (self.spki - self.npki)  # stands for the whole chunk
        peaks, reach = [], max(1, int(0.04 * self.fs))
        for c in top:
            if mwi[c] > threshold:
                self.spki = 0.125 * float(mwi[c]) + 0.875 * self.spki
                lo = max(0, int(c) - reach)
                peaks.append(start + lo + int(np.abs(y[lo : int(c) + reach + 1]).argmax()))
            else:
                self.npki = 0.125 * float(mwi[c]) + 0.875 * self.npki
        if self.chunk > 0 and overlap:
            peaks = [p for p in peaks if p >= start + overlap]
        if not self.compat:
            kept: list[int] = []
            for p in peaks:
                if p - (kept[-1] if kept else self.last if self.last >= 0 else -(10**9)) >= refractory:
                    kept.append(p)
            peaks = kept
        line = peaks if self.compat or self.last < 0 else [self.last, *peaks]
        rr = [d / self.fs for d in np.diff(line).tolist() if DEFAULT.rr_min <= d / self.fs <= DEFAULT.rr_max]
        if peaks:
            self.last = peaks[-1]
        self.recent = (self.recent + rr)[-RECENT:]
        alert, latency = False, None
        for v in rr:
            if 60 / v >= DEFAULT.vt_bpm:
                self.run += 1
                if self.run >= DEFAULT.vt_beats and not self.active:
                    self.active, alert, latency = True, True, v * self.run
                    break  # the rest of this chunk's intervals isn't consumed
            else:
                self.run, self.active = 0, False
        spread = float(y.std())
        out |= {"peaks": peaks, "heart_rate_bpm": 60 / float(np.median(rr)) if rr else None, "emg": bool(len(y) > 8 and spread > 1e-9 and np.diff(y).std() > 2 * spread), "vt_alert": alert, "alert_latency_s": latency}
        self.chunk += 1
        return out


def batch(signal: DataFrame, fs: float = 360.0, chunk_s: float = DEFAULT.edge_chunk_s, overlap_s: float = DEFAULT.edge_overlap_s, compat: bool = False, timed: bool = False) -> DataFrame:
    """The chunk rows of whole recordings; ``timed`` adds ``elapsed_ms``, what a chunk took."""
    ship(signal.sparkSession)

    def one(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")["v"].to_numpy(float)
        n, over = int(chunk_s * fs), int(overlap_s * fs) if compat else 0
        edge, rows = Edge(fs, compat), []
        for a in range(0, len(x), n - over):
            began = time.perf_counter()
            rows.append({"recording_id": key[0], **edge.step(a, x[a : a + n], over)})
            if timed:
                rows[-1]["elapsed_ms"] = 1000 * (time.perf_counter() - began)
        return pd.DataFrame(rows)

    return signal.groupBy("recording_id").applyInPandas(one, CHUNK + ", elapsed_ms double" * timed)


class Buffer:
    """A recording's samples until their chunk is due, and the chunks' state."""

    def __init__(self, fs: float, size: int, patience: int, row: dict | None = None):
        self.edge, self.size, self.patience = Edge(fs), size, patience
        self.waiting: dict[int, float] = {}
        self.following = self.late = 0
        self.missed: list[int] = []  # late samples since the state was read
        if row:
            self.edge.load(row)
            self.waiting, self.following, self.late = dict(zip(row["buffer_idx"], row["buffer_v"], strict=True)), row["next_sample"], row["late"]

    def dump(self) -> tuple:
        d, order = self.edge.dump(), sorted(self.waiting)
        return (self.following, d["chunk_index"], d["zi"], d["spki"], d["npki"], d["last_peak"], d["run"], d["active"], order, [float(self.waiting[i]) for i in order], self.late)

    def add(self, idx: list[int], values: list) -> None:
        for i, v in zip(idx, values, strict=True):
            if i < self.following:
                self.late += 1
                self.missed.append(i)
            else:
                self.waiting[i] = math.nan if v is None else v

    def due(self, everything: bool = False) -> list[dict]:
        """Rows of the chunks that are complete, or whose missing samples aren't waited for any more."""
        out = []
        newest = max(self.waiting, default=-1)
        while self.waiting:
            places = range(self.following, self.following + self.size)
            if not everything and newest < places[-1] + self.patience and not all(i in self.waiting for i in places):
                break
            if not any(i in self.waiting for i in places):  # nothing of this chunk has come: go on with the next that has some
                self.following = min(self.waiting) // self.size * self.size
                fresh = Edge(self.edge.fs)
                fresh.spki, fresh.npki, fresh.chunk = self.edge.spki, self.edge.npki, self.following // self.size
                self.edge = fresh
                continue
            n = min(self.size, newest + 1 - self.following)
            out.append(self.edge.step(self.following, np.array([self.waiting.pop(i, math.nan) for i in range(self.following, self.following + n)], float)) | {"late_samples": self.late})
            self.following += n
        return out


def stream(samples: DataFrame, fs: float = 360.0, chunk_s: float = DEFAULT.edge_chunk_s, patience_s: float = 4.0, idle_s: float | None = None, ttl_s: float | None = None) -> DataFrame:
    """Chunk rows of a stream of ``recording_id, idx, v``.

    Samples that come early wait in the state until their place is reached; a
    place that is still empty when samples of ``patience_s`` beyond its chunk
    have come counts as missing, so a lost sample holds nothing up and what
    waits is bounded.  Samples of a place that has passed are counted as late and
    left out.  With ``idle_s`` a recording that sends nothing for so long is
    closed: its last, partial chunk is emitted and its state dropped.  With
    ``ttl_s`` a state that nothing has changed for so long is dropped without a row.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    ship(samples.sparkSession)
    size, patience = int(chunk_s * fs), int(patience_s * fs)

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("edge", STATE, None if ttl_s is None else int(1000 * ttl_s))

        def load(self) -> Buffer:
            row = dict(zip([c.split()[0] for c in STATE.split(", ")], self.state.get(), strict=True)) if self.state.exists() else None
            return Buffer(fs, size, patience, row)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            own = self.load()
            for pdf in rows:
                own.add(pdf["idx"].tolist(), pdf["v"].tolist())
            out = own.due()
            self.state.update(own.dump())
            if idle_s is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * idle_s))
            if out:
                yield pd.DataFrame([{"recording_id": key[0], **r} for r in out])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            out = self.load().due(everything=True)
            self.state.clear()
            if out:
                yield pd.DataFrame([{"recording_id": key[0], **r} for r in out])

        def close(self) -> None:
            pass

    return samples.groupBy("recording_id").transformWithStateInPandas(Processor(), CHUNK, "Append", "None" if idle_s is None and ttl_s is None else "ProcessingTime")


def stream_events(samples: DataFrame, fs: float = 360.0, time_col: str = "ts", lateness: str = "10 seconds", idle_s: float = 30.0, chunk_s: float = DEFAULT.edge_chunk_s, patience_s: float = 4.0) -> DataFrame:
    """The same of a stream of ``recording_id, idx, v`` with the samples' own times, in event time.

    Rows of ``kind``: ``chunk``; ``late``, with the numbers of samples that came
    after their chunk in ``late_idx`` (a row for each recording and micro-batch;
    what is older than the watermark never reaches the operator and is counted by
    the query's progress, see ``facts.Progress``); ``tail``, a recording's last
    chunk, once the watermark is ``idle_s`` past its latest sample, whereupon its
    state goes.  So what is emitted depends on the samples' times and the
    micro-batches alone, not on the clock: a replay gives the same rows.

    State: a value for filter, levels and waiting samples, and a list of the last
    ``RECENT`` intervals, given as ``recent_rr`` with every row; both are bounded
    and come back from the checkpoint.  A recording that goes on after its tail
    begins anew at the chunk of its next sample.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    ship(samples.sparkSession)
    size, patience, idle = int(chunk_s * fs), int(patience_s * fs), int(1000 * idle_s)

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("edge", STATE)
            self.intervals = handle.getListState("intervals", "rr double")

        def load(self) -> Buffer:
            row = dict(zip([c.split()[0] for c in STATE.split(", ")], self.state.get(), strict=True)) if self.state.exists() else None
            own = Buffer(fs, size, patience, row)
            own.edge.recent = [r[0] for r in self.intervals.get()] if self.intervals.exists() else []
            return own

        def rows(self, key, own: Buffer, everything: bool) -> Iterator[pd.DataFrame]:
            said = own.due(everything)
            more = {"late_idx": [], "recent_rr": own.edge.recent}
            out = [{"recording_id": key[0], **r, "kind": "tail" if everything and r is said[-1] else "chunk", **more} for r in said]
            if own.missed:
                nothing = {"n_samples": 0, "peaks": [], "heart_rate_bpm": None, "emg": False, "vt_alert": False, "alert_latency_s": None}
                out.append({"recording_id": key[0], "chunk_index": own.edge.chunk, "start_sample": own.following, **nothing, "late_samples": own.late, "kind": "late", **more, "late_idx": own.missed})
            if out:
                frame = pd.DataFrame(out)
                yield frame.astype({"heart_rate_bpm": float, "alert_latency_s": float})

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            own, newest = self.load(), 0
            for pdf in rows:
                own.add(pdf["idx"].tolist(), pdf["v"].tolist())
                newest = max(newest, int(pdf[time_col].max().timestamp() * 1000))
            yield from self.rows(key, own, False)
            self.state.update(own.dump())
            if own.edge.recent:
                self.intervals.put([(v,) for v in own.edge.recent])
            timers = list(self.handle.listTimers())
            if newest + idle > max(timers, default=0):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(newest + idle)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self.rows(key, self.load(), True)
            self.state.clear()
            self.intervals.clear()

        def close(self) -> None:
            pass

    return samples.withWatermark(time_col, lateness).groupBy("recording_id").transformWithStateInPandas(Processor(), EVENT, "Append", "EventTime")


def windows(events: DataFrame, length: str = "5 minutes", slide: str | None = None, lateness: str = "10 minutes", time_col: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Tumbling or sliding event-time windows behind a watermark."""
    w = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    out = events.withWatermark(time_col, lateness).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "most")


def sessions(events: DataFrame, gap: str = "5 minutes", lateness: str = "10 minutes", time_col: str = "ts", key: str = "user_id") -> DataFrame:
    out = events.withWatermark(time_col, lateness).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
