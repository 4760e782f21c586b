"""Substring deduplication (operator 4).

Rabin-Karp hashes of every window of ``window`` words are counted over the
whole corpus.  A word goes if a window over it also starts earlier: in a
document of smaller ``doc_id``, or further up in the same document.

How it scales.  Documents are dealt to chunks of some megabytes by a hash of
their id and text (one exchange of the text, used twice).  A chunk first folds its own
repeats together, so a passage that stands in a third of all documents is sent
once per chunk, not once per document.  Chunks send packed hash columns (72
bits a window, and the bucket's own bits) to hash buckets; a bucket answers
with one bit per hash - "an earlier document has it" - and the chunk, which
re-derives the same order from the same exchange, merges flagged windows into
maximal intervals.  Nothing is collected and no task holds more than one chunk
or one bucket.  A chunk asks at most ``fan`` buckets; beyond so many (32 GB of
text by default) they are reached over units of a chunk's size, a level of
exchange of the hashes more for each factor of ``fan`` (``_store.deal``).

Defined cases.  Null or blank text has no words and stays as it is.  A null
``doc_id`` ranks after all others.  Rows that share a ``doc_id`` are documents
of equal rank: neither is earlier than the other.  An empty table gives an
empty one.  Further columns pass
through, whatever their names; the operator's own columns win over columns of
the same name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from . import _store, _words

LAST = np.iinfo(np.int64).max
P = "__pulseframe_chunk"
OWN = ("n_words", "n_removed", "kept_text", "spans")


class Chunk:
    """What a chunk derives from its rows, the same whenever it does so."""

    def __init__(self, rows: pa.Table, window: int, buckets: int, id_col: str, text_col: str):
        self.rows = rows.sort_by([(id_col, "ascending"), (text_col, "ascending")])
        self.words = w = _words.words(self.rows.column(text_col))
        ids = self.rows.column(id_col).combine_chunks()
        ids = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        self.at, (h, g) = w.windows(window, 2)
        row = (np.searchsorted(w.doc, self.at, "right") - 1).astype(np.int32)
        order = np.argsort(h, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = h[order[1:]] != h[order[:-1]]
        self.group = np.empty(len(order), np.int32)  # of each window; groups are numbered by hash
        self.group[order] = np.cumsum(fresh, dtype=np.int32) - 1
        first = order[fresh]  # the first window of each group: of smallest doc_id
        self.flagged = ids[row] > ids[row[first]][self.group] if len(order) else np.zeros(0, bool)
        same = np.zeros(len(order), bool)
        same[1:] = ~fresh[1:] & (row[order[1:]] == row[order[:-1]])
        self.flagged[order[same]] = True
        # What is sent: the first of each group, by bucket and then by place, that is by doc_id.
        bucket = ((g[first] >> _words.U(8)) % _words.U(buckets)).astype(np.int32)
        self.sent = np.lexsort((first, bucket))  # as group numbers
        self.cuts = np.searchsorted(bucket[self.sent], np.arange(buckets + 1))
        pos = first[self.sent]
        self.h, self.g, self.ids = h[pos], g[pos].astype(np.uint8), ids[row[pos]]


def _rows(p: int, base: int, cuts: np.ndarray, ids: np.ndarray, h: np.ndarray, g: np.ndarray) -> pa.Table:
    """A row for each bucket that is asked: its hashes, ordered by id, with runs of ids."""
    out = {k: [] for k in _SENT.names}
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[b], cuts[b + 1]
        own = ids[lo:hi]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        who = own[cut]
        docs = np.r_[who[:1], np.diff(who)].astype("<i8").tobytes() + np.diff(np.r_[cut, hi - lo]).astype("<u4").tobytes()
        for k, v in zip(out, (p, base + b, hi - lo, zlib.compress(docs, 1), h[lo:hi].tobytes(), g[lo:hi].tobytes()), strict=True):
            out[k].append(v)
    return pa.table(out, schema=_SENT)


def _local(*how):
    def run(rows: pa.Table) -> pa.Table:
        c = Chunk(rows, *how)
        return _rows(rows.column(P)[0].as_py(), 0, c.cuts, c.ids, c.h, c.g)

    return run


SENT, BITS = "p long, b long, n long, docs binary, h binary, g binary", "p long, b long, bits binary"
_SENT = pa.schema([("p", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("h", pa.binary()), ("g", pa.binary())])
_BITS = pa.schema([("p", pa.int64()), ("b", pa.int64()), ("bits", pa.binary())])


def _unpack(parts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in parts.column("h")])
    g = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in parts.column("g")])
    ids = []
    for x in parts.column("docs"):
        raw = zlib.decompress(x.as_py())
        k = len(raw) // 12
        ids.append(np.repeat(np.cumsum(np.frombuffer(raw, "<i8", k)), np.frombuffer(raw, "<u4", k, 8 * k)))
    return h, g, np.concatenate(ids)


def _flags(parts: pa.Table, flags: np.ndarray) -> pa.Table:
    bits = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(np.asarray(parts.column("n")))[:-1])]
    return pa.table({"p": parts.column("p"), "b": parts.column("b"), "bits": pa.array(bits, pa.binary())}, schema=_BITS)


def _count(parts: pa.Table) -> pa.Table:
    """For each hash sent to this bucket: whether a smaller doc_id sent it too."""
    h, g, ids = _unpack(parts)
    order = np.argsort(h)
    near = h[order[1:]] == h[order[:-1]]
    many = np.zeros(len(order), bool)
    many[1:] |= near
    many[:-1] |= near
    some = order[many]  # only windows that more than one chunk has
    some = some[np.lexsort((g[some], h[some]))]
    flags = np.zeros(len(h), bool)
    if len(some):
        fresh = np.flatnonzero(np.r_[True, (h[some[1:]] != h[some[:-1]]) | (g[some[1:]] != g[some[:-1]])])
        least = np.minimum.reduceat(ids[some], fresh)
        flags[some] = ids[some] > np.repeat(least, np.diff(np.r_[fresh, len(some)]))
    return _flags(parts, flags)


class Unit:
    """Rows for one bucket from many chunks, that are dealt on: each hash once, with its least id."""

    def __init__(self, parts: pa.Table, buckets: int, depth: int):
        self.parts = parts.sort_by([("p", "ascending")])
        h, g, ids = _unpack(self.parts)
        order = np.lexsort((ids, g, h))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        self.later = ids > ids[first][self.group]
        bucket = (_words.mix(h[first], 41 + depth) % _words.U(buckets)).astype(np.int64)
        self.sent = np.lexsort((ids[first], bucket))
        self.cuts = np.searchsorted(bucket[self.sent], np.arange(buckets + 1))
        at = first[self.sent]
        self.h, self.g, self.ids = h[at], g[at], ids[at]


def _forward(buckets: int, depth: int):
    def run(parts: pa.Table) -> pa.Table:
        u = Unit(parts, buckets, depth)
        return _rows(parts.column("u")[0].as_py(), parts.column("b")[0].as_py() * buckets, u.cuts, u.ids, u.h, u.g)

    return run


def _back(buckets: int, depth: int):
    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        u = Unit(parts, buckets, depth)
        seen = np.zeros(len(u.sent), bool)
        seen[u.sent] = _seen(u.cuts, answers, buckets, len(u.sent))
        return _flags(u.parts, u.later | seen[u.group])

    return run


def _seen(cuts: np.ndarray, answers: pa.Table, buckets: int, n: int) -> np.ndarray:
    """The answered bits in the order in which the hashes were sent."""
    seen = np.zeros(n, bool)
    for b, bits in zip(answers.column("b").to_pylist(), answers.column("bits"), strict=True):
        lo, hi = cuts[b % buckets], cuts[b % buckets + 1]
        seen[lo:hi] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=hi - lo)
    return seen


def kept_text(w: _words.Words, keep: np.ndarray) -> pa.Array:
    """For each document its kept words, joined by one space."""
    which = np.flatnonzero(keep)
    start, length = w.start[which], (w.end - w.start)[which]
    bounds = np.searchsorted(which, w.doc)  # kept words before each document
    sep = np.ones(len(which), np.int64)
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    sep[ends] = 0
    out_end = np.cumsum(length + sep)
    out = np.full(int(out_end[-1]) if len(which) else 0, 0x20, np.uint8)
    if len(which):
        before = np.cumsum(length) - length
        pos = np.arange(int(length.sum()))
        out[np.repeat(out_end - sep - length - before, length) + pos] = w.data[np.repeat(start - before, length) + pos]
    offs = np.r_[0, out_end][bounds]
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _apply(schema: pa.Schema, window: int, *how):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(rows, window, *how)
        if len(c.at):
            by_group = np.empty(len(c.sent), bool)
            by_group[c.sent] = _seen(c.cuts, answers, how[0], len(c.sent))
            c.flagged |= by_group[c.group]
        w = c.words
        n = len(w.start)
        step = np.zeros(n + 1, np.int32)
        hit = c.at[c.flagged]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = np.r_[0, np.cumsum(gone)]
        removed = edge[w.doc[1:]] - edge[w.doc[:-1]]
        # Maximal intervals, as word numbers [from, to) in the document.
        first = np.zeros(n, bool)
        first[w.doc[:-1][w.doc[:-1] < n]] = True
        lo = np.flatnonzero(gone & (first | ~np.r_[False, gone[:-1]])) if n else np.zeros(0, int)
        hi = np.flatnonzero(gone & (np.r_[first[1:], True] | ~np.r_[gone[1:], False])) + 1 if n else np.zeros(0, int)
        per = np.searchsorted(lo, w.doc)
        base = np.repeat(w.doc[:-1], np.diff(per))
        spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(lo - base, pa.int32()), pa.array(hi - base, pa.int32())], ["from", "to"]))
        own = {"n_words": pa.array(np.diff(w.doc), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": kept_text(w, ~gone), "spans": spans}
        return pa.table([own[k].cast(schema.field(k).type) if k in own else c.rows.column(k).combine_chunks() for k in schema.names], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, chunk_bytes: int = 4 << 20, fan: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept_text`` and ``spans`` (removed word intervals [from, to))."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship(spark)
    _, size = _store.text_bytes(docs, text_col)
    chunks, buckets = max(1, -(-size // chunk_bytes)), max(1, -(-size // (2 * chunk_bytes)))
    wide, parts = min(fan, buckets), _store.partitions(spark, size)
    keep = [c for c in docs.columns if c not in OWN]
    # by id and text: rows without an id, or that share one, aren't bound to one chunk
    placed = docs.select(*keep, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).alias(P)).repartition(parts, P)
    how = (window, wide, id_col, text_col)
    sent = placed.groupBy(P).applyInArrow(_local(*how), SENT)
    bits = _store.deal(sent, SENT, -(-buckets // wide), chunks, fan, parts, _count, _forward, _back, BITS)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])))])
    arrow = to_arrow_schema(schema)
    return placed.groupBy(P).cogroup(bits.groupBy("p")).applyInArrow(_apply(arrow, *how), schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same by joins over written-out windows; DuckDB SQL.
ORACLE_SQL = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS k FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 19)) AS i FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
}
