"""Facts of a run, gathered while it runs: no pass of its own over data or results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observe(chunks: DataFrame, fs: float, name: str = "run facts") -> tuple[DataFrame, Observation]:
    """``chunks`` (rows with ``n_samples`` and ``elapsed_ms``) as they are, and an observation that its first action fills."""
    seen = Observation(name)
    n, took = F.col("n_samples"), F.col("elapsed_ms")
    return chunks.observe(seen, F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("samples"), (F.sum(n) / fs).alias("duration_s"), (F.sum(took) / 1000).alias("processing_s"), F.avg(took).alias("mean_chunk_ms"), F.max(took).alias("max_chunk_ms"), F.min("alert_latency_s").alias("detection_latency_s")), seen


def report(facts: dict, target_s: float = 3.0) -> dict:
    """An observation's facts with what follows from them; without samples the rates are None."""
    out = dict(facts)
    busy, length, latency = (facts.get(k) for k in ("processing_s", "duration_s", "detection_latency_s"))
    out["samples_per_s"] = facts["samples"] / max(busy, 1e-9) if facts.get("samples") else None
    out["realtime_ratio"] = busy / max(length, 1e-9) if facts.get("samples") else None
    out["latency_target_met"] = None if latency is None else latency <= target_s
    return out


class Progress(StreamingQueryListener):
    """Micro-batches of a session's streaming queries, as they end: rows, time, rows behind the watermark, rows of state.

    It keeps sums and the longest batch, not a list, so it can stay for as long
    as the session does. ``spark.streams.addListener(Progress())``.
    """

    def __init__(self):
        self.batches = self.rows = self.late = self.state_rows = 0
        self.total_ms = self.longest_ms = 0
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        self.total_ms += p.batchDuration
        self.longest_ms = max(self.longest_ms, p.batchDuration)
        self.late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.state_rows = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended = (self.ended + [event.exception or ""])[-100:]

    def facts(self) -> dict:
        return {"batches": self.batches, "rows": self.rows, "late_rows": self.late, "state_rows": self.state_rows, "mean_batch_ms": self.total_ms / self.batches if self.batches else None, "max_batch_ms": self.longest_ms, "rows_per_s": 1000 * self.rows / self.total_ms if self.total_ms else None}
