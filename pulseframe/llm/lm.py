"""Language-model scores by stupid backoff (operator 6).

The model is the corpus itself, with each document held out of its own score:
the count of an n-gram is its count in all documents less that in this one.
A word scores ``count(n-gram) / count(its context)`` at the longest order that
has been seen elsewhere, times ``alpha`` for every order given up; a word seen
nowhere else counts once in the whole.  A document's score is the sum of logs.

How it scales.  Documents are dealt to chunks by a hash of id and text; a chunk
folds its n-grams of all orders to distinct ones with counts - a frequent
n-gram costs one entry a chunk - and sends them, sorted and delta-coded, to
hash buckets, the partitions of the count tables.  A bucket adds up and answers
each chunk with totals for the n-grams it asked for; the chunk joins them to
its documents' n-grams and sums by document.  The text is exchanged once and
used twice; no table is held whole anywhere.  A chunk asks at most ``fan``
buckets; beyond so many (32 GB of text by default) they are reached over units
of a chunk's size, a level of exchange more for each factor of ``fan``
(``_store.deal``).  Within a bucket n-grams are told apart by 48 bits of their
hash, besides the bits that choose the bucket: of a bucket's some two million,
one in 10^8 is taken for another, at every size of the corpus.

Defined cases.  An empty table gives an empty result.  Null or blank text has no words and a score of 0 over 0 words;
rows that share an id are scored one by one, each held out by itself; further
columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from . import _store, _words
from ._words import U, mix

P = "__pulseframe_chunk"
TOTAL = mix(np.array([6], U), 66)  # stands for the number of words
SENT, BACK = "p long, b long, n long, low binary, high binary, count binary", "p long, b long, count binary"
_SENT = pa.schema([("p", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("count", pa.binary())])
_BACK = pa.schema([("p", pa.int64()), ("b", pa.int64()), ("count", pa.binary())])
SCORES = "doc_id long, n_words long, log_score double, n_full long, n_backed_off long, n_unseen long"


def pack_counts(n: np.ndarray) -> bytes:
    """Counts, mostly small: a byte each, and those of 255 or more in full."""
    big = n >= 255
    return zlib.compress(np.where(big, 255, n).astype(np.uint8).tobytes(), 1) + n[big].astype("<u8").tobytes() + int(big.sum()).to_bytes(8, "little")


def unpack_counts(raw: bytes, k: int) -> np.ndarray:
    big = int.from_bytes(raw[-8:], "little")
    out = np.frombuffer(zlib.decompress(raw[: len(raw) - 8 - 8 * big]), np.uint8, k).astype(np.int64)
    if big:
        out[out == 255] = np.frombuffer(raw, "<u8", big, len(raw) - 8 - 8 * big).astype(np.int64)
    return out


class Chunk:
    """A chunk's n-grams; the same whenever it is derived from the same rows."""

    def __init__(self, rows: pa.Table, order: int, buckets: int):
        self.rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        w = self.words = _words.words(self.rows.column("text"))
        n = len(w.start)
        doc = np.repeat(np.arange(self.rows.num_rows), np.diff(w.doc))
        place = np.arange(n) - w.doc[:-1][doc] if n else np.zeros(0, np.int64)
        self.doc, self.place = doc.astype(np.int32), place.astype(np.int32)
        del doc, place
        self.gram: list[np.ndarray] = []  # for each order and word: number among the distinct ones, or -1
        self.own: list[np.ndarray] = []  # for each order and word: count in the word's document
        keys, counts, base = [], [], 0
        for k in range(1, order + 1):
            at = np.flatnonzero(self.place >= k - 1)
            h = w.grams(k)[at]
            order_ = np.lexsort((self.doc[at], h)) if k == 1 else np.argsort(h, kind="stable")  # stable keeps documents in order
            hs, ds = h[order_], self.doc[at][order_]
            fresh = np.r_[True, hs[1:] != hs[:-1]] if len(hs) else np.zeros(0, bool)
            new = fresh | np.r_[True, ds[1:] != ds[:-1]] if len(hs) else fresh
            runs = np.flatnonzero(new)
            size = np.diff(np.r_[runs, len(hs)])
            gram, own = np.full(n, -1, np.int32), np.zeros(n, np.int32)
            gram[at[order_]] = (np.cumsum(fresh) - 1 + base).astype(np.int32)
            own[at[order_]] = np.repeat(size, size)
            self.gram.append(gram)
            self.own.append(own)
            starts = np.flatnonzero(fresh)
            keys.append(hs[starts])
            counts.append(np.diff(np.r_[starts, len(hs)]))
            base += len(starts)
            del h, hs, ds, order_, at, fresh, new, runs, size
        w.hash = w.data = w.end = None  # not needed any more
        keys.append(TOTAL)
        counts.append(np.array([n]))
        keys, self.counts = np.concatenate(keys), np.concatenate(counts)
        bucket = (mix(keys, 21) % U(buckets)).astype(np.int32)
        low = keys & U((1 << 48) - 1)
        self.sent = np.lexsort((low, bucket))
        self.cuts = np.searchsorted(bucket[self.sent], np.arange(buckets + 1))
        self.low = low[self.sent]
        del keys, bucket, low


def _rows(p: int, base: int, cuts: np.ndarray, low: np.ndarray, counts: np.ndarray) -> pa.Table:
    """A row for each bucket that is asked: its n-grams, ascending, and their counts."""
    out = {k: [] for k in _SENT.names}
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[b], cuts[b + 1]
        step = np.diff(np.r_[U(0), low[lo:hi]])
        for k, v in zip(out, (p, base + b, hi - lo, step.astype("<u4").tobytes(), zlib.compress((step >> U(32)).astype("<u2").tobytes(), 1), pack_counts(counts[lo:hi])), strict=True):
            out[k].append(v)
    return pa.table(out, schema=_SENT)


def _send(order: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        c = Chunk(rows, order, buckets)
        return _rows(rows.column(P)[0].as_py(), 0, c.cuts, c.low, c.counts[c.sent])

    return run


def _unpack(parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for k, low, high, n in zip(parts.column("n").to_pylist(), parts.column("low"), parts.column("high"), parts.column("count"), strict=True):
        step = np.frombuffer(low.as_buffer(), "<u4").astype(U) | (np.frombuffer(zlib.decompress(high.as_py()), "<u2").astype(U) << U(32))
        keys.append(np.cumsum(step))
        counts.append(unpack_counts(n.as_py(), k))
    return np.concatenate(keys), np.concatenate(counts)


def _totals(parts: pa.Table, total: np.ndarray) -> pa.Table:
    cuts = np.r_[0, np.cumsum(np.asarray(parts.column("n")))]
    return pa.table({"p": parts.column("p"), "b": parts.column("b"), "count": pa.array([pack_counts(total[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())}, schema=_BACK)


def _fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, their sums, and the number of each given key among them."""
    order = np.argsort(keys)
    ks = keys[order]
    fresh = np.r_[True, ks[1:] != ks[:-1]]
    starts = np.flatnonzero(fresh)
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ks[starts], np.add.reduceat(counts[order], starts), which


def _add_up(parts: pa.Table) -> pa.Table:
    _, total, which = _fold(*_unpack(parts))
    return _totals(parts, total[which])


class Unit:
    """Rows for one bucket from many chunks, that are dealt on: each n-gram once, with its sum."""

    def __init__(self, parts: pa.Table, buckets: int, depth: int):
        self.parts = parts.sort_by([("p", "ascending")])
        keys, self.counts, self.which = _fold(*_unpack(self.parts))
        bucket = (mix(keys, 41 + depth) % U(buckets)).astype(np.int64)
        self.sent = np.argsort(bucket, kind="stable")  # ascending within a bucket
        self.cuts = np.searchsorted(bucket[self.sent], np.arange(buckets + 1))
        self.low = keys[self.sent]


def _forward(buckets: int, depth: int):
    def run(parts: pa.Table) -> pa.Table:
        u = Unit(parts, buckets, depth)
        return _rows(parts.column("u")[0].as_py(), parts.column("b")[0].as_py() * buckets, u.cuts, u.low, u.counts[u.sent])

    return run


def _back(buckets: int, depth: int):
    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        u = Unit(parts, buckets, depth)
        return _totals(u.parts, _answered(u, answers, buckets)[u.which])

    return run


def _answered(c, answers: pa.Table, buckets: int) -> np.ndarray:
    """The totals of what a chunk or unit has sent, by its own numbers."""
    total = np.zeros(len(c.counts), np.int64)
    for b, raw in zip(answers.column("b").to_pylist(), answers.column("count"), strict=True):
        lo, hi = c.cuts[b % buckets], c.cuts[b % buckets + 1]
        total[c.sent[lo:hi]] = unpack_counts(raw.as_py(), hi - lo)
    return total


def _score(order: int, buckets: int, alpha: float):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(rows, order, buckets)
        total = _answered(c, answers, buckets)
        docs, n = c.rows.num_rows, len(c.doc)
        size = np.diff(c.words.doc)
        seen = [np.where(g >= 0, total[g] - own, 0) for g, own in zip(c.gram, c.own, strict=True)]  # elsewhere
        words = np.maximum(total[-1] - size, 1)[c.doc] if n else np.zeros(0)
        score, level, given_up = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(order, 0, -1):
            could = (c.place >= k - 1) & (level == 0)
            hit = np.flatnonzero(could & (seen[k - 1] > 0))
            # Elsewhere, whatever ended here also began: the context was seen at least as often.
            context = seen[k - 2][hit - 1] - 0 if k > 1 else words[hit]
            if k > 1:  # the context as it is counted within the document reaches its last word, too
                context = np.maximum(context, seen[k - 1][hit])
            score[hit] = np.log(seen[k - 1][hit] / context) + given_up[hit] * np.log(alpha)
            level[hit] = k
            given_up[could & (level == 0)] += 1
        none = np.flatnonzero(level == 0)
        score[none] = given_up[none] * np.log(alpha) - np.log(words[none] + 1)
        top = np.minimum(c.place + 1, order)
        add = lambda v: np.bincount(c.doc, weights=v, minlength=docs) if n else np.zeros(docs)
        whole = lambda v: pa.array(np.rint(add(v)).astype(np.int64))
        return pa.table({"doc_id": c.rows.column("doc_id"), "n_words": pa.array(size.astype(np.int64)), "log_score": pa.array(add(score)), "n_full": whole((level == top) & (level > 0)), "n_backed_off": whole((level < top) & (level > 0)), "n_unseen": whole(level == 0)})

    return run


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, chunk_bytes: int = 8 << 20, fan: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, log_score`` and the words scored at full order, backed off, and unseen."""
    spark = docs.sparkSession
    ship(spark)
    _, size = _store.text_bytes(docs, text_col)
    chunks, buckets = max(1, -(-size // chunk_bytes)), max(1, -(-2 * size // chunk_bytes))
    wide, parts = min(fan, buckets), _store.partitions(spark, size)
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks))
    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), place.alias(P)).repartition(parts, P)
    sent = placed.groupBy(P).applyInArrow(_send(order, wide), SENT)
    back = _store.deal(sent, SENT, -(-buckets // wide), chunks, fan, parts, _add_up, _forward, _back, BACK)
    return placed.groupBy(P).cogroup(back.groupBy("p")).applyInArrow(_score(order, wide, alpha), SCORES)


def score_rows(docs: DataFrame, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trigram scores as ``score`` gives them, with a row for every n-gram: count tables by hash, joined to the exploded n-grams, summed by document.

    It shuffles many times the text (README); ``score`` sends the same in packed columns.
    """
    w = F.col("w")
    at = lambda i, k: F.xxhash64(F.lit(k), *(F.get(w, i - j) for j in range(k)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), _store.sql_words(text_col).alias("w"))
    rows = _store.materialize(rows, "scored-rows")
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(i.alias("i"), *(F.when(i >= k - 1, at(i, k)).alias(f"x{k}") for k in (1, 2, 3))))
    words = rows.filter(F.size(w) > 0).select("row", F.size(w).alias("n"), F.inline(grams))
    one = words.select("row", "i", F.explode(F.array("x1", "x2", "x3")).alias("x")).filter("x IS NOT NULL")
    own = one.groupBy("row", "x").agg(F.count(F.lit(1)).alias("own"))  # hashes hold their order
    table = own.groupBy("x").agg(F.sum("own").alias("every"))
    seen = own.join(table, "x").select("row", "x", (F.col("every") - F.col("own")).alias("seen"))
    total = words.count()  # one number
    for k in (1, 2, 3):
        words = words.join(seen.select("row", F.col("x").alias(f"x{k}"), F.col("seen").alias(f"c{k}")), ["row", f"x{k}"], "left")
    order = Window.partitionBy("row").orderBy("i")
    words = words.withColumns({"u": F.lag("c1").over(order), "b": F.lag("c2").over(order)})
    rest = F.greatest(F.lit(total) - F.col("n"), F.lit(1))
    cut = F.log(F.lit(alpha))
    level = F.when(F.col("c3") > 0, 3).when(F.col("c2") > 0, 2).when(F.col("c1") > 0, 1).otherwise(0)
    value = F.when(F.col("c3") > 0, F.log(F.col("c3") / F.col("b"))).when(F.col("c2") > 0, F.log(F.col("c2") / F.col("u")) + F.least(F.col("i") - 1, F.lit(1)) * cut)
    value = value.when(F.col("c1") > 0, F.log(F.col("c1") / rest) + F.least(F.col("i"), F.lit(2)) * cut).otherwise(F.least(F.col("i") + 1, F.lit(3)) * cut - F.log(rest + 1))
    top = F.least(F.col("i") + 1, F.lit(3))
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = words.withColumn("level", level).groupBy("row").agg(F.sum(value).alias("log_score"), hit((F.col("level") > 0) & (F.col("level") == top)).alias("n_full"), hit((F.col("level") > 0) & (F.col("level") < top)).alias("n_backed_off"), hit(F.col("level") == 0).alias("n_unseen"))
    out = rows.join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"), zero("n_full"), zero("n_backed_off"), zero("n_unseen"))


def op6_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    out = score(_store.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumns({"log_score": F.round("log_score", 4), "mean_log": F.round(F.try_divide("log_score", "n_words"), 4)})


#: The same by window counts over written-out n-grams; DuckDB SQL.
ORACLE_SQL = {
    "op6_stupid_backoff": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i, len(w) AS n FROM d),
q AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS y, lag(x, 2) OVER (PARTITION BY doc_id ORDER BY i) AS z, count(*) OVER () AS total FROM p),
c AS (SELECT *, count(*) OVER (PARTITION BY x) - count(*) OVER (PARTITION BY doc_id, x) AS c1,
             CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY y, x) - count(*) OVER (PARTITION BY doc_id, y, x) ELSE 0 END AS c2, CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY z, y, x) - count(*) OVER (PARTITION BY doc_id, z, y, x) ELSE 0 END AS c3 FROM q),
k AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS u, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS b, greatest(total - n, 1) AS rest FROM c),
s AS (SELECT doc_id, i, CASE WHEN c3 > 0 THEN ln(c3 / b) WHEN c2 > 0 THEN ln(c2 / u) + least(i - 2, 1) * ln(0.4) WHEN c1 > 0 THEN ln(c1 / rest) + least(i - 1, 2) * ln(0.4) ELSE least(i, 3) * ln(0.4) - ln(rest + 1) END AS v,
             CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS level FROM k),
t AS (SELECT doc_id, sum(v) AS log_score, count(*) FILTER (level > 0 AND level = least(i, 3)) AS n_full, count(*) FILTER (level > 0 AND level < least(i, 3)) AS n_backed_off, count(*) FILTER (level = 0) AS n_unseen FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(log_score, 0.0), 4) AS log_score, coalesce(n_full, 0) AS n_full, coalesce(n_backed_off, 0) AS n_backed_off, coalesce(n_unseen, 0) AS n_unseen, round(log_score / nullif(len(w), 0), 4) AS mean_log FROM d LEFT JOIN t USING (doc_id)
"""
}
