"""Sharding by histogram sort (operator 10).

Rows are sorted by a key into shards of nearly equal bytes.  No sample decides
the cuts: each round counts, exactly and over all rows, the bytes and rows
below a few hundred candidate keys, and lays the next candidates between the
two that enclose each wanted cut.  When every cut is within the tolerance (or
a single key is all that lies between), rows are exchanged once.

The law is ``bytes``.  The sort key is ``(hash of the text, hash of the id)``:
equal texts are neighbours, and a group of copies of any size can still be cut
by its ids.  Shards are divided further at known candidates, so that no task
sorts more than ``part_bytes`` (up to ``most_parts`` divisions, 32 TB at the
defaults; beyond, they grow in proportion); since the rows below each division are known
from the counts, ``slot`` is the division's first slot plus the row's place in
it, gapless without a pass over a whole shard.

Defined cases.  Null text has size 1 (its end), as has the empty text; null
ids are allowed.  Identical rows share a key and lie together, whatever cut
falls among them; ties are in no stated order.  An empty table
gives an empty result.  The operator keeps all columns of its input (its own
``size, law, shard, slot, grown_shard`` replace columns of those names).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from . import _store

KEY, TIE = "__pulseframe_key", "__pulseframe_tie"
HALF, TOP = 1 << 63, 1 << 128


def _pairs(probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit probes as signed halves, which sort as the rows' own two longs do."""
    k = np.array([(p >> 64) - HALF for p in probes], np.int64)
    t = np.array([(p & ((1 << 64) - 1)) - HALF for p in probes], np.int64)
    return k, t


def place(k: np.ndarray, t: np.ndarray, pk: np.ndarray, pt: np.ndarray) -> np.ndarray:
    """How many probes are at or below each (k, t)."""
    lo, hi = np.searchsorted(pk, k, "left"), np.searchsorted(pk, k, "right")
    for key in np.unique(k[hi > lo]):
        rows = np.flatnonzero(k == key)
        a, b = lo[rows[0]], hi[rows[0]]
        lo[rows] = a + np.searchsorted(pt[a:b], t[rows], "right")
    return lo


def histogram(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe, over all rows; what comes back is one row per interval."""
    pk, pt = _pairs(probes)

    def run(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = place(b.column(0).to_numpy(), b.column(1).to_numpy(), pk, pt)
            np.add.at(size, at, b.column(2).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["at", "bytes", "rows"])

    found = keys.select(KEY, TIE, "size").mapInArrow(run, "at long, bytes long, rows long").groupBy("at").agg(F.sum("bytes"), F.sum("rows")).collect()
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for at, b, r in found:
        size[at], rows[at] = b, r
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def splitters(keys: DataFrame, shards: int, total: int, rows: int, tolerance: float, first: int, per_cut: int = 16) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """The cuts, and all counts made on the way: key -> (bytes, rows) below."""
    known = {0: (0, 0), TOP: (total, rows)}
    wanted = [total * j // shards for j in range(1, shards)]
    slack = tolerance * total / shards
    probes = sorted({TOP * i // first for i in range(1, first)})
    while probes:
        known.update(zip(probes, zip(*histogram(keys, probes), strict=True), strict=True))
        marks = sorted(known)
        weights = [known[m][0] for m in marks]
        probes = set()
        for w in wanted:
            i = int(np.searchsorted(weights, w, "right"))
            lo, hi = marks[i - 1], marks[min(i, len(marks) - 1)]
            near = min(abs(known[lo][0] - w), abs(known[hi][0] - w))
            if near > slack and known[hi][1] - known[lo][1] > 1 and hi - lo > 1:
                probes |= {lo + (hi - lo) * j // (per_cut + 1) for j in range(1, per_cut + 1)} - {lo, hi}
        probes = sorted(probes - known.keys())
    marks = sorted(known)
    cuts = [min(marks, key=lambda m: (abs(known[m][0] - w), m)) for w in wanted]
    return cuts, known


def shard(docs: DataFrame, shards: int = 16, size: Column | None = None, key: Column | None = None, tie: Column | None = None, tolerance: float = 0.001, part_bytes: int = 32 << 20, most_parts: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``size, law, shard, slot, grown_shard``."""
    spark = docs.sparkSession
    ship(spark)
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1 if size is None else size
    key = F.xxhash64(F.col(text_col)) if key is None else key
    tie = F.xxhash64(F.col(id_col)) if tie is None else tie
    docs = docs.withColumns({"size": size, KEY: key, TIE: tie})
    with _store.scratch(spark):
        return _shard(docs, _store.materialize(docs.select(KEY, TIE, "size"), "shard-keys"), shards, tolerance, part_bytes, most_parts)


def _shard(docs: DataFrame, keys: DataFrame, shards: int, tolerance: float, part_bytes: int, most_parts: int) -> DataFrame:
    spark = docs.sparkSession
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    part = max(1, min(part_bytes, total // max(shards, _store.partitions(spark))))
    first = int(min(most_parts, max(16 * shards, 4 * total // part)))
    cuts, known = splitters(keys, shards, total, rows, tolerance, first)
    # Divisions: the cuts, and between them known candidates that keep each division under ``part`` where they can.
    bounds, owner, base, at = [], [0], [0], 0
    for m in [m for m in sorted(known) if 0 < m < TOP]:
        n = cuts.count(m)
        if n:
            bounds += [m] * n
            for _ in range(n):
                owner.append(owner[-1] + 1)
                base.append(0)
            at, zero = known[m][0], known[m][1]
        elif known[m][0] - at >= part:
            bounds.append(m)
            owner.append(owner[-1])
            base.append(known[m][1] - (zero if owner[-1] else 0))
            at = known[m][0]
    n0 = cuts.count(0)  # cuts below all keys: shards that stay empty at the front
    owner = [o + n0 for o in owner]
    pk, pt = _pairs(bounds)

    @F.pandas_udf("int")
    def division(k: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(place(k.to_numpy(), t.to_numpy(), pk, pt).astype(np.int32))

    placed = docs.drop("shard", "slot").withColumn("__division", division(KEY, TIE))
    order = Window.partitionBy("__division").orderBy(KEY, TIE)
    # one row a division: at most some ``most_parts`` and the probes around the cuts
    divisions = spark.createDataFrame(pa.table({"__division": pa.array(np.arange(len(owner)), pa.int32()), "shard": pa.array(owner, pa.int32()), "__base": pa.array(base, pa.int64())}))
    out = placed.withColumn("slot", F.row_number().over(order).cast("long") - 1).join(F.broadcast(divisions), "__division")
    out = out.withColumns({"slot": F.col("slot") + F.col("__base"), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    out = out.select(*[c for c in docs.columns if c not in ("shard", "slot", "law", "grown_shard")], "law", "shard", "slot", "grown_shard")
    return out.drop("__division", KEY, TIE)


def op10_histogram_sharding(spark, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", F.octet_length(text).cast("long").alias("__bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("__hash"))
    narrow = _store.materialize(narrow, "shard-rows")  # the query returns no texts, so they are read once
    out = shard(narrow, size=F.col("__bytes") + 1, key=F.col("__hash"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
