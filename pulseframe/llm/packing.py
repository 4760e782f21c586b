"""Lexical retrieval packing (operator 7).

Documents become token ids (``WordBpe``, then id ``end_id``) and are packed
into sequences of ``window`` tokens.  Within a shard - a run of documents of
bounded token count - a BM25 inverted index over token ids returns, for each
seed document, its unused neighbours, best first, until none that shares a term
is left; they fill the seed's window greedily.  The document that no longer
fits is cut, and its rest is the next seed, so every window is full.  What is
left at a shard's end is laid out in sequences whose lengths are powers of two,
which need no padding.

How it scales.  Documents are sorted by four MinHash values of their words, so
that like documents come to one shard wherever they stood in the input; a seed
sees its own shard only.  Ranges are of rows, with the row's place as the last
sort column: a key that many documents have is spread over several.  That is
one shuffle of the texts; memory is bounded by ``shard_tokens`` and
``shard_docs`` (plus one document, or one batch of them).  ``sequence_id`` holds the partition's number and a count within it.

Defined cases.  A null or empty text, or one of characters that the tokenizer
drops (no-break spaces), yields the end id alone; any length is packed whole;
repeated rows and ids are packed as they come; neighbours of equal score come in
the shard's order.  An empty table gives no sequences.  Columns other than id
and text aren't read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import _store, _words
from ._bpe import WordBpe
from ._words import U, mix

K1, B = 1.2, 0.75


class Shard:
    """A BM25 index over the shard's documents, and the greedy packing by it."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, window: int, end_id: int = -1):
        self.ids, self.size, self.window = ids, size, window
        self.begin = np.r_[0, np.cumsum(size)]
        n = len(size)
        doc = np.repeat(np.arange(n, dtype=np.uint64), size)
        key, tf = np.unique((ids.astype(np.uint64) << np.uint64(32)) | doc, return_counts=True)
        term, who = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        df = np.bincount(term, minlength=1 << 16)
        use = (df[term] >= 2) & (term != end_id)  # others lead nowhere; the end is no document's own
        term, who, tf = term[use], who[use], tf[use]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[who] / size.mean()))).astype(np.float32)
        self.who, self.weight = who, weight
        self.post = np.searchsorted(term, np.arange((1 << 16) + 1))
        # Frequent terms as rows of a matrix, of fewer than four cells a posting
        often = np.setdiff1d(np.flatnonzero(df > max(2, n // 4)), [end_id])
        self.row = np.full(1 << 16, -1)
        self.row[often] = np.arange(len(often))
        self.often = np.zeros((len(often), n), np.float32)
        part = self.row[term] >= 0
        self.often[self.row[term[part]], who[part]] = weight[part]
        # Each document's query: all its terms.
        order = np.argsort(who, kind="stable")
        self.query, self.query_at = term[order], np.searchsorted(who[order], np.arange(n + 1))
        self.unused = np.ones(n, np.float32)
        self.left = np.bincount(term, minlength=1 << 16)  # unused documents of each term

    def use(self, doc: int) -> None:
        self.unused[doc] = 0
        self.left[self.query[self.query_at[doc] : self.query_at[doc + 1]]] -= 1  # a document has a term once

    def neighbours(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with ``doc``, best first; they are sorted as far as they are asked for.

        A term that no unused document has is passed over, and where the terms have
        few postings only these are touched: a document that leads nowhere costs
        its own terms, not a look at the shard.
        """
        terms = self.query[self.query_at[doc] : self.query_at[doc + 1]]
        terms = terms[self.left[terms] > 0]
        if not len(terms):
            return
        row = self.row[terms]
        rest = terms[row < 0]
        size = self.post[rest + 1] - self.post[rest]
        at = np.repeat(self.post[rest] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if len(rest) == len(terms) and 8 * len(at) < len(unused):
            at = at[unused[self.who[at]] > 0]
            docs, place = np.unique(self.who[at], return_inverse=True)
            score = np.bincount(place, self.weight[at]).astype(np.float32)
        else:
            ask = np.zeros(len(self.often), np.float32)
            ask[row[row >= 0]] = 1
            score = ask @ self.often
            score += np.bincount(self.who[at], self.weight[at], len(score)).astype(np.float32)
            score *= unused
            docs = np.flatnonzero(score)
            score = score[docs]
        left, many = len(docs), 32
        while left:
            many = min(many, left)
            least = np.partition(score, len(score) - many)[len(score) - many]
            found = np.flatnonzero(score >= least)
            yield from docs[found[np.lexsort((found, -score[found]))]].tolist()
            score[found] = 0
            left, many = left - len(found), many * 8

    def pack(self) -> list[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of every piece."""
        size, window = self.size.tolist(), self.window
        unused = self.unused
        pieces: list[tuple[int, int, int, int, int]] = []
        sequence, filled, after = 0, 0, 0
        open_at = 0  # first piece of the open window
        seed, taken = -1, 0
        while True:
            if seed < 0:
                while after < len(size) and not unused[after]:
                    after += 1
                if after == len(size):
                    break
                seed, taken = after, 0
                self.use(seed)
            queue, origin = None, seed
            while True:  # fill one window
                part = min(size[seed] - taken, window - filled)
                pieces.append((seed, taken, part, sequence, filled))
                filled, taken = filled + part, taken + part
                if taken == size[seed]:
                    seed = -1
                if filled == window:
                    sequence, filled, open_at = sequence + 1, 0, len(pieces)
                    break
                if queue is None:
                    queue = self.neighbours(origin, unused)
                seed, taken = next(queue, -1), 0
                if seed < 0:
                    while after < len(size) and not unused[after]:
                        after += 1
                    if after == len(size):
                        break
                    seed, origin, queue = after, after, None
                self.use(seed)
        if filled:  # the rest, in sequences of a power of two each
            rest, pieces[open_at:] = pieces[open_at:], []
            for bit in range(filled.bit_length() - 1, -1, -1):
                room, at = filled & (1 << bit), 0
                while room:
                    d, s, k, *_ = rest[0]
                    part = min(k, room)
                    pieces.append((d, s, part, sequence, at))
                    rest[0] = (d, s + part, k - part, 0, 0)
                    if part == k:
                        rest.pop(0)
                    at, room = at + part, room - part
                sequence += bool(at)
        return pieces


def _keyed(batches):
    """Rows with a sort key of four MinHash values of the document's words, and the row's place, by which rows of one key are dealt."""
    place = TaskContext.get().partitionId() << 40
    for b in _words.slices(batches, "text", 2 << 20):
        w = _words.words(b.column(1))
        has = np.flatnonzero(np.diff(w.doc))
        key = np.zeros(b.num_rows, U)
        for r in range(4 if len(has) else 0):
            odd = U((0x9E3779B97F4A7C15 * (2 * r + 1)) & 0xFFFFFFFFFFFFFFFF)
            key[has] |= mix(np.minimum.reduceat(w.hash * odd, w.doc[has]), r) >> U(48) << U(48 - 16 * r)
        at = np.arange(place, place + b.num_rows)
        place += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.view(np.int64)), pa.array(at)], names=["doc_id", "text", "key", "place"])


def pack(docs: DataFrame, window: int = 2048, shard_tokens: int = 2_000_000, shard_docs: int = 200_000, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``start, length, doc_tokens, sequence_id, offset`` and ``ids`` (unsigned 32-bit, little-endian)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    ship(docs.sparkSession)
    tokenizer = str(tokenizer)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.mapInArrow(_keyed, "doc_id long, text string, key long, place long")
    docs = docs.repartitionByRange("key", "place").sortWithinPartitions("key", "place").select("doc_id", "text")

    def run(batches):
        gc.disable()  # nothing here is cyclic, and the caches are large
        bpe, made = WordBpe(tokenizer), 0
        names: list[pa.Array] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush():
            nonlocal made
            size, ids = np.concatenate(sizes), np.concatenate(parts)
            doc_ids = pa.concat_arrays(names)
            for held in (names, parts, sizes):
                held.clear()
            shard = Shard(ids, size, window, end_id)
            found = shard.pack()
            base = (TaskContext.get().partitionId() << 40) + made
            made += found[-1][3] + 1
            for a in range(0, len(found), 4096):
                some = np.array(found[a : a + 4096], np.int64)
                at = shard.begin[some[:, 0]] + some[:, 1]
                blobs = [ids[x : x + k].astype("<u4").tobytes() for x, k in zip(at.tolist(), some[:, 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(some[:, 0])), pa.array(some[:, 1]), pa.array(some[:, 2]), pa.array(size[some[:, 0]]), pa.array(base + some[:, 3]), pa.array(some[:, 4]), pa.array(blobs, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in _words.slices(batches, "text", 2 << 20):
            ids, cut = bpe.encode(b.column(1))
            names.append(b.column(0))
            parts.append(np.insert(ids, cut[1:], end_id))
            sizes.append(np.diff(cut) + 1)
            if sum(map(len, parts)) >= shard_tokens or sum(map(len, sizes)) >= shard_docs:
                yield from flush()
        if parts:
            yield from flush()

    return docs.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op7_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(_store.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
