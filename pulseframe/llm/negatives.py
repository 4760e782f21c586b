"""Hard-negative mining by a two-dimensional block matrix product (operator 11).

Vectors become whole numbers, so every score is an exact inner product.  Rows
and anchors are sharded into blocks, a panel each.  As in SUMMA, the tile of
anchor block ``i`` and row block ``j`` is the sum over chunks of the dimensions
of panel products, and stays where it is computed: anchor panels go to all strips of
row panels (a broadcast join), a task multiplies each of its row panels by
each anchor panel, chunk by chunk, and keeps only the best few of each anchor
and window so far, whose worst bounds what the next tile can add.  No tile is
stored or shuffled; a strip passes on its best few once, at its end.

Blocks don't mix label groups (hash groups of labels), which splits the grid in
two passes that overlap only where a group has several labels: tiles within a
group give the positives, the others the negatives.  No tile is computed twice
for a group of one label.

Disk: rows are shuffled once, into panels; then a strip sends ``positives *
(1 + negatives)`` rows an anchor.  There are at most ``STRIPS`` strips (or as
many as cores), however many rows there are, so all of it grows as the input does.

Memory: a tile has at most ``anchor_block * block`` cells, a panel at most
``PANEL_BYTES``; blocks are dealt by row number, so a hot label or a repeated row only
has more blocks.  Anchors go in rounds of at most ``ROUND_BYTES`` of panels and
bounds, which is what is broadcast at once and what a task keeps the best of; each
round reads all rows again.  The driver gets six facts a label group
(``GROUPS`` at most).  The work is anchors times rows; nothing is left out.

Defined cases.  Rows with a null label, a null vector, or a null or non-finite
component take no part.  A row without an id is never an anchor, ranks after
all ids and is returned with a null id.  Shorter vectors count as padded with
zeros, an empty one scores 0.  Repeated rows are rows of their own: each is an
"other row" to its copies.  Ties go to the smaller id, then to any of the equal
rows.  Scores that could exceed 64 bits raise.  No rows or no anchors give an
empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from . import _store

#: Hash groups of labels: the bound of what the driver lays the grid out from.
GROUPS = 256
#: Strips of row panels that meet an anchor panel, if there aren't more cores.
STRIPS = 64
PANEL_BYTES, ROUND_BYTES = 8 << 20, 16 << 20
PANEL = "block long, g int, pure boolean, data binary, head binary"
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(vectors: DataFrame, anchor: Column, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """Rows that take part: ``uid, id, label, anchor, q`` with whole-number components."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(label.isNotNull() & v.isNotNull() & ~odd)
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), q.alias("q"))


class Head:
    """Ids, row numbers and labels of a block, in the order of its rows."""

    def __init__(self, raw: bytes):
        a = np.frombuffer(raw, np.int64).reshape(4, -1)
        self.uid, self.id, self.null, self.label = a[0], a[1], a[2].astype(bool), a[3]

    def named(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.id[at], mask=self.null[at])


def _pack(width: int, kind: str):
    def run(t: pa.Table) -> pa.Table:
        uid, label = t["uid"].to_numpy(), t["label"].to_numpy()
        null = t["id"].is_null().to_numpy()
        ids = t["id"].fill_null(0).to_numpy()
        order = np.lexsort((uid, ids, null))  # by id, those without last: the first of equal scores is the one wanted
        q = t["q"].combine_chunks()
        sizes = q.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.zeros((len(uid), width), kind)
        data[np.repeat(np.arange(len(uid)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = q.flatten().to_numpy()
        head = np.stack([uid[order], ids[order], null[order].astype(np.int64), label[order]]).tobytes()
        return pa.table({c: t[c][:1] for c in ("block", "g", "pure")} | {"data": pa.array([data[order].tobytes()], pa.binary()), "head": pa.array([head], pa.binary())})

    return run


def _top(scores: np.ndarray, k: int, low):
    """(lines, columns, scores) of each line's ``k`` best in turn; ``scores`` is used up, and ``low`` stands for no score."""
    lines = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(1)  # the first of equals
        best = scores[lines, at]
        some = np.flatnonzero(best > low)
        if not len(some):
            return
        yield lines[some], at[some], best[some]
        scores[lines, at] = low


class Best:
    """The ``k`` best rows, so far, of each anchor of a block within each of its windows ``lo..hi`` of scores (a column a window)."""

    def __init__(self, head: Head, lo: np.ndarray, hi: np.ndarray, k: int, same: bool, work: str):
        self.head, self.k, self.same, self.windows = head, k, same, lo.shape[1]
        self.low = -np.inf if work != "<i8" else LOW
        self.least, self.most = (np.where(x == LOW, self.low, np.where(x == HIGH, -self.low if work != "<i8" else HIGH, x)).astype(work) for x in (lo, hi))
        self.parts, self.waiting = [np.zeros((5, 0), np.int64)], 0
        self._bound()

    def _bound(self):
        self.all_least, self.all_most = self.least.min(1)[:, None], self.most.max(1)[:, None]

    def _push(self, x, w, y, z, rows: Head):
        self.parts.append(np.stack([x * self.windows + w, z.astype(np.int64), rows.null[y].astype(np.int64), rows.id[y], rows.uid[y]]))
        self.waiting += len(x)

    def settle(self) -> np.ndarray:
        """Rows of place (anchor and window), score, null id, id, uid: the best ``k`` of each place, in order."""
        found = np.concatenate(self.parts, 1)
        found = found[:, np.lexsort((found[4], found[3], found[2], -found[1], found[0]))]
        new = np.flatnonzero(np.diff(found[0], prepend=-1))
        rank = np.arange(found.shape[1]) - np.repeat(new, np.diff(new, append=found.shape[1]))
        full = rank == self.k - 1
        self.least[found[0, full] // self.windows, found[0, full] % self.windows] = found[1, full]  # equal scores still come in, by id
        self._bound()
        found = found[:, rank < self.k]
        self.parts, self.waiting = [found], 0
        return found

    def add(self, s: np.ndarray, rows: Head):
        """Take in a tile of scores."""
        some = (s >= self.all_least) & (s <= self.all_most)
        n = np.count_nonzero(some)
        if n <= 16 * len(s):
            x, y = np.nonzero(some)
            fits = (self.head.label[x] == rows.label[y]) == self.same
            if self.same:
                fits &= self.head.uid[x] != rows.uid[y]
            x, y = x[fits], y[fits]
            z = s[x, y]
            for w in range(self.windows):
                m = (z >= self.least[x, w]) & (z <= self.most[x, w])
                self._push(x[m], w, y[m], z[m], rows)
        else:  # many: the tile's own best first
            some &= (self.head.label[:, None] == rows.label[None, :]) == self.same
            if self.same:
                some &= self.head.uid[:, None] != rows.uid[None, :]
            for w in range(self.windows):
                own = np.where(some & (s >= self.least[:, w, None]) & (s <= self.most[:, w, None]), s, s.dtype.type(self.low))
                for x, y, z in _top(own, self.k, self.low):
                    self._push(x, w, y, z, rows)
        if n > 16 * len(s) or self.waiting > len(s) * self.windows * self.k:
            self.settle()


def _product(a: np.ndarray, b: np.ndarray, chunk: int) -> np.ndarray:
    """A tile, added up over the chunks of the dimensions."""
    total = a[:, :chunk] @ b[:, :chunk].T
    for k in range(chunk, a.shape[1], chunk):
        total += a[:, k : k + chunk] @ b[:, k : k + chunk].T
    return total


def _search(width: int, kind: str, work: str, chunk: int, k: int, same: bool, low: int, high: int):
    """Row panels, each beside the anchor panels that it meets; the best of the strip for each anchor and window at its end."""

    def panel(raw) -> np.ndarray:
        return np.frombuffer(raw.as_buffer(), kind).reshape(-1, width).astype(work)

    def run(batches):
        anchors, at, rows, b = {}, None, None, None
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for r, (i, j) in enumerate(zip(col["i"].to_pylist(), col["j"].to_pylist(), strict=True)):
                if j != at:
                    at, rows, b = j, Head(col["row_head"][r].as_py()), panel(col["row_data"][r])
                if i not in anchors:
                    head = Head(col["head"][r].as_py())
                    lo = hi = np.zeros((len(head.uid), 1), np.int64)
                    if same:
                        lo, hi = lo + LOW, hi + HIGH
                    else:
                        p = np.frombuffer(col["wanted"][r].as_buffer(), np.int64).reshape(len(head.uid), -1)
                        none, p = p == LOW, np.where(p == LOW, 0, p)
                        lo, hi = np.where(none, HIGH, -(-low * p // 100)), np.where(none, LOW, high * p // 100)
                    anchors[i] = panel(col["data"][r]), Best(head, lo, hi, k, same, work)
                a, best = anchors[i]
                best.add(_product(a, b, chunk), rows)
        for i, (_, best) in anchors.items():
            place, score, null, ids, uid = best.settle()
            line = place // best.windows
            # a row an anchor, window and place: who it is, and who was found
            yield pa.record_batch({"i": np.full(len(place), i), "anchor": best.head.uid[line], "anchor_id": best.head.id[line], "turn": (place % best.windows + 1).astype(np.int32), "found": uid, "found_id": pa.array(ids, mask=null.astype(bool)), "score": score})

    return run


FOUND = "i long, anchor long, anchor_id long, turn int, found long, found_id long, score long"


def _wanted(positives: int):
    """Anchor panels with the scores of their positives, in turn."""

    def run(t: pa.Table, near: pa.Table) -> pa.Table:
        if not (t.num_rows and near.num_rows):  # no positives: no negatives
            return pa.table({c: t[c][:0] for c in t.schema.names} | {"wanted": pa.array([], pa.binary())})
        uid = Head(t["head"][0].as_py()).uid
        wanted, order = np.full((len(uid), positives), LOW), np.argsort(uid)
        wanted[order[np.searchsorted(uid, near["anchor"].to_numpy(), sorter=order)], near["turn"].to_numpy() - 1] = near["score"].to_numpy()
        return t.append_column("wanted", pa.array([wanted.tobytes()], pa.binary()))

    return run


def mine(vectors: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 2048, anchor_block: int = 512, chunk: int = 32) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A negative has another label than the anchor and ``low * positive_score <=
    100 * negative_score <= high * positive_score``; each anchor's ``positives``
    best rows of its label get their ``negatives`` best.
    """
    spark = vectors.sparkSession
    ship(spark)
    with _store.scratch(spark) as keep:
        rows = _store.materialize(whole(vectors, anchor, id_col, F.col("label") if label is None else label, vector_col, scale), "negatives-rows")
        return keep(_store.materialize(_mine(rows, positives, negatives, low, high, block, anchor_block, chunk), "negatives"))


def _mine(rows: DataFrame, positives: int, negatives: int, low: int, high: int, block: int, anchor_block: int, chunk: int) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.withColumn("g", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))
    most = F.array_max(F.transform("q", lambda x: F.abs(x.cast("double")) + 1))
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    groups = rows.groupBy("g").agg(F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1)), F.min("label") == F.max("label"), F.max(F.size("q")), F.max(most), F.max(norm)).collect()  # GROUPS rows at most
    top, dims, square = max((int(r[5] or 0) for r in groups), default=0), max((r[4] for r in groups), default=0), max((r[6] for r in groups), default=0.0)
    if dims * top * top >= 1 << 56:
        raise ValueError("scores of these vectors may exceed 64 bits")
    # no sum of some of a product's terms exceeds the greatest square of a length: below what the type holds exactly, the vectorised routine is exact
    work = next((w for w, n in (("<f4", 24), ("<f8", 53)) if square < 0.99 * (1 << n)), "<i8")
    kind = next(k for k in ("<i2", "<i4", "<i8") if top < 1 << (8 * int(k[2]) - 1))
    width = max(1, dims)
    block, anchor_block = (max(1, min(n, PANEL_BYTES // (width * int(kind[2])))) for n in (block, anchor_block))
    laid, i, j = [], 0, 0
    for g, n, a, pure, *_ in groups:
        nj, ni = -(-n // block), -(-a // anchor_block)
        laid.append((g, j, nj, i, ni, pure))
        i, j = i + ni, j + nj
    total, anchors = sum(r[1] for r in groups), sum(r[2] for r in groups)
    # low: the row blocks of the group; high: its anchor blocks
    grid = F.broadcast(spark.createDataFrame(laid, "g int, lows long, low_n long, highs long, high_n long, pure boolean"))
    placed = rows.join(grid, "g")

    def panels(part: DataFrame, first: str, n: str, count: int, name: str) -> DataFrame:
        dealt = part.select("uid", "id", "label", "q", "g", "pure", (F.col(first) + F.pmod(F.xxhash64("uid"), F.col(n))).alias("block"))
        dealt = dealt.repartition(_store.partitions(spark, 10 * count * width), "block")
        return _store.materialize(dealt.groupBy("block").applyInArrow(_pack(width, kind), PANEL), name)

    row_panels = panels(placed, "lows", "low_n", total, "negatives-rows-packed").select(F.col("block").alias("j"), F.col("g").alias("row_g"), F.col("data").alias("row_data"), F.col("head").alias("row_head"))
    strips = row_panels.coalesce(max(STRIPS, spark.sparkContext.defaultParallelism))
    anchor_panels = panels(placed.filter("anchor"), "highs", "high_n", anchors, "negatives-anchors-packed").withColumnRenamed("block", "i")
    own = F.col("g") == F.col("row_g")

    def search(side: DataFrame, met: Column, k: int, same: bool) -> DataFrame:
        columns = ["i", "j", "data", "head", "row_data", "row_head"] + ([] if same else ["wanted"])
        return strips.join(F.broadcast(side), met).select(*columns).mapInArrow(_search(width, kind, work, chunk, k, same, low, high), FOUND)

    def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    each = max(1, ROUND_BYTES // (anchor_block * (width * int(kind[2]) + 8 * (4 + positives))))
    rounds = []
    for start in range(0, max(1, i), each):
        side = anchor_panels.filter((F.col("i") >= start) & (F.col("i") < start + each))
        near = best(search(side, own, positives, True).drop("turn"), ["anchor"], positives).withColumnRenamed("rank", "turn")
        near = _store.materialize(near, "negatives-windows")
        windows = side.groupBy("i").cogroup(near.groupBy("i")).applyInArrow(_wanted(positives), f"i long, {PANEL.split(', ', 1)[1]}, wanted binary")
        far = best(search(_store.materialize(windows, "negatives-wanted"), ~(F.col("pure") & own), negatives, False), ["anchor", "turn"], negatives)
        far = far.select("anchor", "turn", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
        far = far.join(near.select("anchor", "turn", "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "turn"])
        far = far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        rounds.append(_store.materialize(far, "negatives-round") if each < i else far)
    return reduce(DataFrame.union, rounds)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_store.table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 50 == 0, label=moved)


ORACLE_SQL = {
    "op11_hard_negatives": """
WITH e AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.uid AS a, a.vec_id AS anchor_id, b.uid AS b, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM e a JOIN e b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0),
p AS (
  SELECT a, anchor_id, b AS p, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id NULLS LAST, b) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.other_id NULLS LAST, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
}
