"""Recursive filters over recordings of any length, in parallel within a recording.

A cascade of second-order sections is an affine map of its state, and such maps
compose: over ``n`` samples the state goes from ``s`` to ``M**n s + e``, where
``e`` is what the samples leave in a filter that starts from nothing.  So a
recording is cut into chunks, and each pass over it takes three steps: every
chunk's ``e``, all in parallel; a scan of the few numbers a chunk, level by level
so that no task gets more than ``fan`` of a recording's chunks; every chunk
filtered from the state that the scan gives it, all in parallel again.  The way
back is the same on reversed chunks.  Results equal the filter over the whole
recording up to rounding.

Samples are exchanged once a pass by ``(recording_id, chunk)``; the two readings
of a pass share that exchange.  Memory: a task holds a chunk of ``size`` samples.

Defined cases.  ``idx`` counts from 0; absent and NULL samples are read as 0
(fill gaps before).  A zero-phase filter leaves a recording alone that isn't
longer than its extension, as ``dsp.zero_phase`` does.  No rows give none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..runtime import settled, ship

KEY = ["recording_id", "chunk"]
CHUNK = "recording_id string, chunk long, first boolean, last boolean, plain boolean, lead long, tail long, x binary"


def extension(sos: np.ndarray) -> int:
    """Samples by which a zero-phase filter extends either end."""
    trailing = min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    return 3 * (2 * len(sos) + 1 - trailing)


@lru_cache(64)
def _over(raw: bytes, n: int) -> np.ndarray:
    """The map of the state over ``n`` samples of nothing: where each unit of it goes, which loses less than a power of the map over one."""
    sos = np.frombuffer(raw).reshape(-1, 6)
    return np.stack([dsp.sos_filter(sos, np.zeros(n), e.reshape(-1, 2))[1].ravel() for e in np.eye(2 * len(sos))], 1)


def _row(t: pa.Table, name: str):
    return t[name][0].as_py()


def chunks(signal: DataFrame, size: int, pad: int) -> DataFrame:
    """A row for every chunk; the ends of a recording carry its odd extension by ``pad`` samples."""
    if size <= pad:
        raise ValueError(f"chunks of {size} samples are shorter than the extension of {pad}")
    ship(signal.sparkSession)

    def pack(t: pa.Table) -> pa.Table:
        at = t["idx"].to_numpy() - _row(t, "chunk") * size
        x = np.zeros(int(at.max()) + 1)
        x[at] = np.nan_to_num(t["v"].fill_null(0.0).to_numpy(), nan=0.0, posinf=0.0, neginf=0.0)
        return pa.table({"recording_id": t["recording_id"][:1], "chunk": t["chunk"][:1], "n": [len(x)], "end": pa.array([x[-pad - 1 :].tolist()], pa.list_(pa.float64())), "x": pa.array([x.tobytes()], pa.binary())})

    def extend(t: pa.Table, facts: pa.Table) -> pa.Table:
        x = np.frombuffer(_row(t, "x"))
        first, last, before = (_row(facts, c) for c in ("first", "last", "before"))
        plain = first and last and len(x) <= pad
        lead = tail = 0
        if pad and not plain:
            near = x if first or len(x) > pad else np.concatenate([before or [], x])
            if first:
                lead = pad
            if last:
                tail = pad
            x = np.concatenate([2 * x[0] - x[pad:0:-1] if lead else x[:0], x, 2 * x[-1] - near[-2 : -pad - 2 : -1] if tail else x[:0]])
        return pa.table({"recording_id": t["recording_id"], "chunk": t["chunk"], "first": [first], "last": [last], "plain": [plain], "lead": [lead], "tail": [tail], "x": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})

    keyed = signal.select(F.col("recording_id").cast("string").alias("recording_id"), F.floor(F.col("idx") / size).cast("long").alias("chunk"), F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))
    packed = settled(keyed.groupBy(*KEY).applyInArrow(pack, "recording_id string, chunk long, n long, end array<double>, x binary"))
    order = Window.partitionBy("recording_id").orderBy("chunk")  # over chunks, not samples
    facts = packed.select(F.col("recording_id").alias("of"), F.col("chunk").alias("at"), F.lag("end").over(order).alias("before"), F.lag("n").over(order).isNull().alias("first"), F.lead("n").over(order).isNull().alias("last"))
    return packed.groupBy(*KEY).cogroup(facts.groupBy("of", "at")).applyInArrow(extend, CHUNK)


def scan(sums: DataFrame, sos: np.ndarray, fan: int) -> DataFrame:
    """``of, at, state``: the state before each of ``sums(of, at, n, e)``, in the order of ``at``; each recording starts from nothing, and what its first chunk starts from is in that chunk's ``e``."""
    width, raw = 2 * len(sos), np.ascontiguousarray(sos, float).tobytes()
    lists = pa.list_(pa.float64())

    def fold(t: pa.Table, start: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t, s = t.sort_by("at"), start
        before = np.empty((t.num_rows, width))
        for i, (n, e) in enumerate(zip(t["n"].to_pylist(), t["e"].to_pylist(), strict=True)):
            before[i] = s
            s = _over(raw, n) @ s + np.array(e)
        return t, before, s

    def states(t: pa.Table, start: np.ndarray) -> pa.Table:
        t, before, _ = fold(t, start)
        return pa.table({"of": t["of"], "at": t["at"], "state": pa.array(before.tolist(), lists)})

    result = "of string, at long, state array<double>"
    low, high = sums.agg(F.min("at"), F.max("at")).first()
    if low is None or high - low < fan:
        return sums.groupBy("of").applyInArrow(lambda t: states(t, np.zeros(width)), result)

    def whole(t: pa.Table) -> pa.Table:
        t, _, s = fold(t, np.zeros(width))
        return pa.table({"of": t["of"][:1], "at": t["over"][:1], "n": [int(np.sum(t["n"].to_numpy()))], "e": pa.array([s.tolist()], lists)})

    placed = sums.withColumn("over", F.floor(F.col("at") / fan).cast("long"))
    above = settled(placed.groupBy("of", "over").applyInArrow(whole, "of string, at long, n long, e array<double>"))
    starts = scan(above, sos, fan).select(F.col("of").alias("of_"), F.col("at").alias("over_"), F.col("state").alias("start"))
    return placed.groupBy("of", "over").cogroup(starts.groupBy("of_", "over_")).applyInArrow(lambda t, s: states(t, np.array(_row(s, "start"))), result)


def run(parts: DataFrame, sos: np.ndarray, backward: bool = False, settle: bool = True, fan: int = 4096) -> DataFrame:
    """All chunks filtered, forwards or backwards, each recording from the steady state of its first sample on that way."""
    zi = dsp.sos_state(sos)

    def begin(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(_row(t, "x"))
        x = x[::-1] if backward else x
        return x, zi * x[0] if _row(t, "last" if backward else "first") else np.zeros_like(zi)

    def leave(t: pa.Table) -> pa.Table:
        x, state = begin(t)
        _, state = dsp.sos_filter(sos, x, state)
        at = _row(t, "chunk")
        return pa.table({"of": t["recording_id"], "at": [-at if backward else at], "n": [len(x)], "e": pa.array([state.ravel().tolist()], pa.list_(pa.float64()))})

    def go(t: pa.Table, s: pa.Table) -> pa.Table:
        if _row(t, "plain"):
            return t
        x, state = begin(t)
        y, _ = dsp.sos_filter(sos, x, state + np.array(_row(s, "state")).reshape(state.shape))
        y = np.ascontiguousarray(y[::-1] if backward else y)
        return t.set_column(t.schema.get_field_index("x"), "x", pa.array([y.tobytes()], pa.binary()))

    sums = settled(parts.groupBy(*KEY).applyInArrow(leave, "of string, at long, n long, e array<double>"))
    states = scan(sums, sos, fan)
    if backward:
        states = states.withColumn("at", -F.col("at"))
    out = parts.groupBy(*KEY).cogroup(states.groupBy("of", "at")).applyInArrow(go, CHUNK)
    return settled(out) if settle else out


def samples(parts: DataFrame, size: int) -> DataFrame:
    """``recording_id, idx, v`` again, without the extensions."""

    def spread(batches):
        for b in batches:
            for k in range(b.num_rows):
                x = np.frombuffer(b.column("x")[k].as_py())
                lead, tail, at = (b.column(c)[k].as_py() for c in ("lead", "tail", "chunk"))
                x = x[lead : len(x) - tail]
                for a in range(0, len(x), 8192):
                    v = x[a : a + 8192]
                    yield pa.RecordBatch.from_pydict({"recording_id": [b.column("recording_id")[k].as_py()] * len(v), "idx": at * size + a + np.arange(len(v)), "v": v})

    return parts.mapInArrow(spread, "recording_id string, idx long, v double")


def zero_phase(signal: DataFrame, sos: np.ndarray, size: int = 1 << 16, fan: int = 4096) -> DataFrame:
    """``dsp.zero_phase`` of every recording."""
    parts = chunks(signal, size, extension(sos))
    return samples(run(run(settled(parts), sos, fan=fan), sos, backward=True, settle=False, fan=fan), size)


def causal(signal: DataFrame, sos: np.ndarray, size: int = 1 << 16, fan: int = 4096) -> DataFrame:
    """Forwards only, from the steady state of the first sample."""
    return samples(run(settled(chunks(signal, size, 0)), sos, settle=False, fan=fan), size)
