"""Benchmark decontamination (operator 1).

For every benchmark item, windows of the item's own length slide over each
document; a document that is shorter than the item is one window.  A window's
SimHash (64 bits, over weighted word shingles) is looked up in multi-index
Hamming blocks: 64 bits are cut into ``blocks`` parts, and if two fingerprints
differ in at most ``radius`` bits, one part differs in at most ``radius //
blocks`` bits.  Items are listed by the value of each part, and a window looks
up all values so near to its own, so every fingerprint within the radius is met.
Candidates within the radius are confirmed by the exact weighted Jaccard
similarity of their shingle multisets, ``threshold`` or more.  An item of fewer
words than a shingle is a single one, all its words, and so is its window.

Words are compared in lower case and without ASCII punctuation.  A shingle
weighs the more, the fewer items have it (``ln(1 + items / items with it)``); one
that no item has weighs most.  Windows are fingerprinted only where the weight
of shingles that some item has is at least ``threshold`` of the window's
weight: below that the similarity can't reach the threshold with any item, so
nothing is lost.

How it scales.  Documents are read once, without a shuffle; rows keep their
place.  Items are a query set.  Up to ``index_bytes`` of index (some 40 bytes a
word) they are one block, a broadcast.  Beyond, they are cut into blocks of that
size, which the driver builds one after another into files that Spark sends to
the executors (``SparkContext.addFile``); one Python worker a task walks the blocks for
some megabytes of text at a time, with one of them in memory.  Weights are those
of all items in every block: shingles that two or more items have are counted once, in
Spark, and go to a sorted file, in ranges, that workers map into memory.  So
neither the driver nor a worker ever holds more than a block.

Defined cases.  Null or blank texts have no windows; very long ones are searched
whole, in one piece; items that are null or have no words aren't searched for;
an item without an id is reported without one; items of equal text are all reported.  Of windows
that tie in similarity the one of fewer bits apart, then the first, is reported.
An empty table on either side finds nothing.  Rows aren't merged.  Columns of the documents pass through (their
own ``leaks`` is replaced).
"""

from __future__ import annotations

import math
import os
import pickle
import tempfile
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from . import _store, _words
from ._words import U, mix

_KEEP = np.ones(256, bool)
_KEEP[[b for b in range(128) if not chr(b).isalnum() and chr(b) not in " \t\n\x0b\f\r"]] = False
_BITS = np.arange(64, dtype=U)
FIELDS = ("item_id", "start_word", "n_words", "similarity", "hamming")
LEAK = "array<struct<item_id:long,start_word:int,n_words:int,similarity:double,hamming:int>>"


def plain_words(column) -> _words.Words:
    """Words without ASCII punctuation; the text is in lower case already."""
    data, offs = _words.strings(column)
    keep = _KEEP[data]
    at = np.r_[0, np.cumsum(keep)]
    return _words.words(pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(at[offs].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))))


def lowered(texts: list[str]) -> pa.Array:
    return pa.array([t.lower() for t in texts], pa.string())


def item_shingles(column, shingle: int) -> np.ndarray:
    """Shingle hashes of items, once for each item that has them."""
    w = plain_words(column)
    at, (h,) = w.windows(shingle)
    return np.unique(np.stack([h, (np.searchsorted(w.doc, at, "right") - 1).astype(U)]), axis=1)[0]


class Index:
    """Fingerprints, shingles and Hamming blocks of a set of items.

    ``whole``: if these are a block of the items, how many there are in all,
    and files of the shingles that two or more of all have (ascending) and of
    their weights; these are the same then whatever the block.
    """

    def __init__(self, ids: list[int | None], texts: list[str], shingle: int, radius: int, blocks: int, threshold: float, whole: tuple[int, str, str] | None = None):
        self.shingle, self.radius, self.blocks, self.threshold = shingle, radius, blocks, threshold
        w = plain_words(lowered(texts))
        size = np.diff(w.doc)
        at, (h,) = w.windows(shingle)
        owner = np.searchsorted(w.doc, at, "right") - 1
        self.items = np.flatnonzero(size >= shingle)
        self.ids, self.size = ids, size
        both = np.unique(np.stack([owner.astype(U), h]), axis=1, return_counts=True)
        (own, self.keys), self.counts = both[0], both[1].astype(np.int32)
        self.bag = np.searchsorted(own, np.arange(len(ids) + 1).astype(U))  # where each item's shingles begin
        self.known, df = np.unique(self.keys, return_counts=True)
        n, self.apart = whole[0] if whole else len(ids), whole is not None
        if whole:
            self.look(*whole[1:])
        else:
            self.shared, self.weights = self.known[df > 1], np.log1p(n / df[df > 1])
        self.unknown = math.log1p(n / 1) if n else 1.0  # and of shingles that one item has
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.known >> U(44)).astype(np.int64)] = True
        self.prints = np.zeros(len(ids), U)
        begin = np.searchsorted(owner, np.arange(len(ids) + 1))
        for i in self.items.tolist():
            mine = h[begin[i] : begin[i + 1]]
            self.prints[i] = self.fingerprint(mine, self.weigh(mine))
        self.lengths = sorted({int(size[i]) for i in self.items})
        # Items that are shorter than a shingle: (words, hash, item), by hash
        self.short = []
        for m in range(1, shingle):
            few = np.flatnonzero(size == m)
            if len(few):
                at, (h,) = w.windows(m)
                h = h[np.isin(at, w.doc[few])]  # those that begin their item, in order
                order = np.argsort(h, kind="stable")
                self.short.append((m, h[order], few[order]))
        # Multi-index: for each part the items by its value, and the differences of radius // blocks bits at most.
        self.width = 64 // blocks
        self.flips = np.array([sum(1 << b for b in c) for k in range(radius // blocks + 1) for c in combinations(range(self.width), k)], np.uint64)
        self.tables = []
        for p in range(blocks):
            part = self.part(self.prints[self.items], p)
            order = np.argsort(part, kind="stable")
            value, first = np.unique(part[order], return_index=True)
            self.tables.append((value, np.r_[first, len(order)], self.items[order].astype(np.int32)))

    def look(self, shared: str, weights: str) -> "Index":
        """Take shared shingles and their weights from files."""
        self.shared, self.weights = (np.memmap(f, kind, "r") if os.path.getsize(f) else np.zeros(0, kind) for f, kind in ((shared, U), (weights, float)))
        return self

    def __getstate__(self) -> dict:
        return self.__dict__ | ({"shared": None, "weights": None} if self.apart else {})

    def part(self, prints: np.ndarray, p: int) -> np.ndarray:
        return (prints >> U(p * self.width)) & U((1 << self.width) - 1)

    def near(self, part: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``part``, place in ``value``) of all that differ in few enough bits: by whichever are fewer, the values there are or those within reach."""
        if len(value) <= len(self.flips):
            return np.nonzero(np.bitwise_count(part[:, None] ^ value[None, :]) <= self.radius // self.blocks)
        wanted = part[:, None] ^ self.flips[None, :]
        at = np.minimum(np.searchsorted(value, wanted), len(value) - 1)
        x, f = np.nonzero(value[at] == wanted)
        return x, at[x, f]

    def weigh(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(keys), self.unknown)
        at = np.minimum(np.searchsorted(self.shared, keys), len(self.shared) - 1)
        return np.where(self.shared[at] == keys, self.weights[at], self.unknown)

    @staticmethod
    def signs(keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
        whole = np.rint(weight * 1024).astype(np.int64)[:, None]  # whole numbers, so that sums don't depend on their order
        return np.where((mix(keys, 17)[:, None] >> _BITS) & U(1), whole, -whole)

    def fingerprint(self, keys: np.ndarray, weight: np.ndarray) -> U:
        return U(sum(1 << i for i, v in enumerate(self.signs(keys, weight).sum(0)) if v > 0))

    def candidates(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """(place, item) of all items within the radius of each fingerprint."""
        out = set()
        for p, (value, begin, item) in enumerate(self.tables):
            for a in range(0, len(prints) if len(value) else 0, 256):
                some = prints[a : a + 256]
                x, v = self.near(self.part(some, p), value)
                n = begin[v + 1] - begin[v]
                who = np.repeat(x, n)
                found = item[np.repeat(begin[v] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                near = np.bitwise_count(self.prints[found] ^ some[who]) <= self.radius
                out.update(zip((who[near] + a).tolist(), found[near].tolist(), strict=True))
        return sorted(out)

    def similarity(self, window: np.ndarray, weight: np.ndarray, item: int) -> float:
        bag = slice(self.bag[item], self.bag[item + 1])
        keys, n, w = self.keys[bag], self.counts[bag], self.weigh(self.keys[bag])
        mine, at, count = np.unique(window, return_index=True, return_counts=True)
        _, a, b = np.intersect1d(mine, keys, assume_unique=True, return_indices=True)
        both = float((np.minimum(count[a], n[b]) * w[b]).sum())
        return both / (float((count * weight[at]).sum()) + float((n * w).sum()) - both)

    def search_short(self, w: _words.Words) -> list[tuple[int, tuple]]:
        """(document, hit) of the first place of every item that is shorter than a shingle."""
        out = []
        for m, keys, items in self.short:
            at, (h,) = w.windows(m)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            met = np.flatnonzero(hi > lo)
            doc = np.searchsorted(w.doc, at[met], "right") - 1
            first = np.unique(np.stack([doc, lo[met]]), axis=1, return_index=True)[1]
            for x, d in zip(met[first].tolist(), doc[first].tolist(), strict=True):
                out += [(d, (self.ids[i], int(at[x] - w.doc[d]), m, 1.0, 0)) for i in items[lo[x] : hi[x]].tolist()]
        return out

    def search(self, h: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """Best window for each item in a document with shingle hashes ``h``, by word."""
        weight = self.weigh(h)
        hit = self.sieve[(h >> U(44)).astype(np.int64)]
        hit &= np.isin(h, self.known)
        total, mine = np.r_[0, np.cumsum(weight)], np.r_[0, np.cumsum(weight * hit)]
        places = []
        # for items that have more shingles than the document, the document is the one window
        for k in sorted({min(size - self.shingle + 1, len(h)) for size in self.lengths}):
            at = np.flatnonzero(mine[k:] - mine[:-k] >= (self.threshold - 1e-9) * (total[k:] - total[:-k]))
            places.append(np.stack([at, np.full(len(at), k)]))
        if not places or not (places := np.concatenate(places, axis=1)).shape[1]:
            return []
        best: dict[int, tuple] = {}
        # Sign sums over the parts of the document in which such windows lie
        touched = np.zeros(len(h) + 1, np.int32)
        np.add.at(touched, places[0], 1)
        np.add.at(touched, places[0] + places[1], -1)
        inside = np.flatnonzero(np.cumsum(touched[:-1]) > 0)
        row = np.full(len(h) + 1, 0, np.int64)
        row[inside] = np.arange(len(inside))
        sums = np.zeros((len(inside) + 1, 64), np.int64)
        np.cumsum(self.signs(h[inside], weight[inside]), axis=0, out=sums[1:])
        for a in range(0, places.shape[1], 4096):
            at, k = places[0, a : a + 4096], places[1, a : a + 4096]
            first = row[at]
            bits = sums[first + k] - sums[first] > 0
            prints = np.packbits(bits, axis=1, bitorder="little").view(U).ravel()
            for x, item in self.candidates(prints):
                if min(self.size[item] - self.shingle + 1, len(h)) != k[x]:
                    continue
                s = slice(at[x], at[x] + k[x])
                sim = self.similarity(h[s], weight[s], item)
                if sim >= self.threshold - 1e-9:
                    ham = int(np.bitwise_count(self.prints[item] ^ prints[x]))
                    new = (-sim, ham, int(at[x]))
                    if item not in best or new < best[item]:
                        best[item] = new
        return [(self.ids[i], b[2], min(int(self.size[i]), len(h) + self.shingle - 1), -b[0], b[1]) for i, b in sorted(best.items())]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5, radius: int = 16, blocks: int = 4, index_bytes: int = 64 << 20, text_col: str = "text", keep_text: bool = True, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: for each item found its id, place (in words without punctuation), length, similarity and bits apart."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != "leaks" and (keep_text or c != text_col)]
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(100 + 40 * F.size(_store.sql_words("text"))), F.lit(0))).first()
    parts = math.ceil(1.5 * size / index_bytes) if size > index_bytes else 1

    def block(rows: list, whole=None) -> Index:
        return Index([r.id for r in rows], [r.text for r in rows], shingle, radius, blocks, threshold, whole)

    if parts == 1:
        bound = docs.sparkSession.sparkContext.broadcast(block(items.orderBy("id", "text").collect()))  # index_bytes at most
        each = lambda: (bound.value,)
    else:
        each = _in_files(items, n, parts, shingle, index_bytes, block)
    lower = "__pulseframe_lower"
    source = docs.select(*[c for c in docs.columns if c != "leaks"]).withColumn(lower, F.lower(F.col(text_col))).select(*keep, lower)
    schema = T.StructType([source.schema[c] for c in keep] + T.StructType.fromDDL(f"leaks {LEAK}").fields)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64()), ("hamming", pa.int32())]))

    def run(batches):
        for b in _words.slices(batches, lower, 4 << 20):
            w = plain_words(b.column(len(keep)))
            at, (h,) = w.windows(shingle)
            cuts = np.searchsorted(at, w.doc)
            found: list = [[] for _ in range(b.num_rows)]
            for index in each():
                maybe = np.flatnonzero(index.sieve[(h >> U(44)).astype(np.int64)])
                maybe = maybe[np.isin(h[maybe], index.known)]
                for d in np.unique(np.searchsorted(w.doc, at[maybe], "right") - 1).tolist():
                    found[d] += [dict(zip(FIELDS, x, strict=True)) for x in index.search(h[cuts[d] : cuts[d + 1]])]
                for d, x in index.search_short(w):
                    found[d].append(dict(zip(FIELDS, x, strict=True)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, kind)], names=[*keep, "leaks"])

    return source.mapInArrow(run, schema)


def _in_files(items: DataFrame, n: int, parts: int, shingle: int, piece: int, block):
    """Indexes of ``parts`` blocks of the items, as files on every executor; a function that gives them one at a time."""
    sc = items.sparkSession.sparkContext
    folder, name = tempfile.mkdtemp(prefix="pulseframe-items-"), f"pulseframe-items-{uuid.uuid4().hex}"
    path = lambda kind: os.path.join(folder, f"{name}-{kind}")

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(item_shingles(lowered(b.column(0).to_pylist()), shingle).view(np.int64))], names=["shingle"])

    with _store.scratch(items.sparkSession):
        shared = items.select("text").mapInArrow(count, "shingle long").groupBy("shingle").count().filter("count > 1")
        shared = _store.materialize(shared, "item-shingles")
        ranges = max(1, -(-16 * shared.count() // piece))
        # hashes are even, so ranges of their high bits are; unsigned order, as the workers look them up
        at = F.floor(F.shiftrightunsigned("shingle", 32).cast("double") * ranges / (1 << 32))
        with open(path("shared"), "wb") as keys, open(path("weights"), "wb") as weights:
            for r in range(ranges):
                got = shared.filter(at == r).toArrow()
                own = got.column(0).to_numpy().view(U)
                order = np.argsort(own)
                keys.write(own[order].tobytes())
                weights.write(np.log1p(n / got.column(1).to_numpy()[order]).tobytes())
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).orderBy("id", "text").collect()  # a block
        with open(path(k), "wb") as f:
            pickle.dump(block(rows, (n, path("shared"), path("weights"))), f, protocol=5)
    for kind in ("shared", "weights", *range(parts)):
        sc.addFile(path(kind))

    def each():
        files = [SparkFiles.get(f"{name}-{kind}") for kind in ("shared", "weights")]
        for k in range(parts):
            with open(SparkFiles.get(f"{name}-{k}"), "rb") as f:
                yield pickle.load(f).look(*files)

    return each


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_leaks(docs, _store.table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.start_word", "x.n_words", F.round("x.similarity", 6).alias("similarity"), "x.hamming")
