"""Ranked lexical search: an inverted index in shards, blocks of variable length, exact skipping (operator 12).

``statistics`` counts documents and terms.  ``build`` then indexes every row: a
shard is some ``unit`` bytes of texts of one input partition, so that postings
needn't be shuffled; each (shard, term) is a row of the index with its postings
(document and impact, the part of the score that doesn't depend on the term's
weight) and its blocks.  Documents of a shard are numbered by length, which
keeps impacts of neighbours alike.  A dynamic program lays the block bounds: of
all cuts into blocks of up to ``widest`` postings it takes the one of least
cost, a block's cost being a constant and its bound error, the sum over its
postings of the largest impact less their own.  All lists of a shard go through
the program at once, a posting each step.

``search`` joins the query terms with the index's terms - the term's weight
needs the counts of all shards -, brings the lists of a shard and a block of
queries together, and ranks there.  As in WAND with block maxima, the pivots
are found from bounds alone: block bounds of a query's terms, weighted and
summed, bound the score of every document between two neighbouring block ends.
Stretches are taken by falling bound; only postings in blocks that reach into a
taken stretch are read; what can't reach the k-th best score so far is never
touched.  Equal bounds are not skipped, so ties come out exactly.

Memory: a task holds a shard's postings and one block of queries (``query_rows``
terms at most, or one query).  Nothing is sent to the driver but three counts.

Defined cases.  Null and empty texts, and texts without terms, aren't counted
and never found.  Queries without terms, or whose terms no document has, give
no rows.  Rows of one id are documents of their own, as are queries; a document
without an id ranks after all ids of its score.  Equal scores go by id, equal
ids by any order.  Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from . import _store, _words

_GAPS = np.zeros(256, bool)  # fixed values: ASCII but its digits and letters
_GAPS[:128] = [not chr(c).isalnum() for c in range(128)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
INDEX = "shard long, term string, df long, docs binary, impacts binary, ends binary, tops binary"
LIST = ("docs", "impacts", "ends", "tops")


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``start``."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def found_terms(column) -> _words.Words:
    return _words.words(column, _GAPS, _FOLD)


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all terms of theirs."""

    def run(batches):
        for b in _words.slices(batches, "text"):
            n = np.diff(found_terms(b.column(0)).doc)
            yield pa.RecordBatch.from_pydict({"n": pa.array([int((n > 0).sum())]), "l": pa.array([int(n.sum())])})

    row = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def numbered(w: _words.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its term, and the first word of every term. Hashes group the words, bytes decide."""
    size = w.end - w.start
    _, first, term = np.unique(w.hash, return_index=True, return_inverse=True)
    same = size == size[first][term]
    for a in range(0, len(size), 1 << 17):  # a stretch at a time: a byte needs 17 here
        b = min(a + (1 << 17), len(size))
        own = np.flatnonzero(same[a:b]) + a
        at, length = w.start[own], size[own]
        away = np.repeat(w.start[first][term[own]] - at, length)
        here = spans(at, length)
        bad = w.data[here] != w.data[here + away]
        if bad.any():
            same[np.repeat(own, length)[bad]] = False
    if not same.all():  # two terms of one hash
        raw = [w.data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
        _, first, term = np.unique(np.array(raw, object), return_index=True, return_inverse=True)
    return term.reshape(-1), first


def cut(impacts: np.ndarray, sizes: np.ndarray, cost: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of all lists (laid end to end in ``impacts``): ends within each list, and how many blocks each list has.

    Least total of ``cost`` a block and of bound errors, over all cuts into blocks of up to ``widest`` postings.
    """
    base = np.cumsum(sizes) - sizes
    back = np.ones(len(impacts), np.int64)  # postings of the best last block, for every end
    order = np.argsort(-sizes, kind="stable")
    order = order[: int((sizes[order] > 1).sum())]
    n, at = len(order), base[order]
    longest = int(sizes[order[0]]) if n else 0
    widest = max(1, min(widest, longest))
    active = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # lists with more than i postings
    top = np.zeros((n, widest), np.int64)  # largest impact since each start
    paid = np.full((n, widest), 1 << 60, np.int64)  # least cost up to each start, and impacts before it
    best, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(longest):
        a, slot = int(active[i]), i % widest
        x = impacts[at[:a] + i]
        t, p = top[:a], paid[:a]
        np.maximum(t, x[:, None], out=t)
        t[:, slot] = x
        p[:, slot] = best[:a] + before[:a]
        before[:a] += x
        length = (slot - np.arange(widest)) % widest + 1
        total = t * length
        total += p
        choice = total.argmin(1)
        best[:a] = total[np.arange(a), choice] - before[:a] + cost
        back[at[:a] + i] = length[choice]
    ends = np.zeros(len(impacts), bool)
    live, end = np.arange(len(sizes)), sizes.copy()
    while len(live):
        last = base[live] + end[live] - 1
        ends[last] = True
        end[live] -= back[last]
        live = live[end[live] > 0]
    found = np.flatnonzero(ends)
    counts = np.add.reduceat(ends, base).astype(np.int64) if len(base) else np.zeros(0, np.int64)
    return found - np.repeat(base, counts) + 1, counts


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of int32 values as binary strings."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(4 * sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def postings(column, ids: pa.Array, shard: int, documents: int, terms: int, cost: int, widest: int) -> pa.RecordBatch | None:
    """The rows of one shard: a list for each term; the row without a term has the documents' ids (and, as impacts, which have none)."""
    w = found_terms(column)
    n = np.diff(w.doc)
    order = np.flatnonzero(n > 0)
    order = order[np.argsort(n[order], kind="stable")]
    if not len(order):
        return None
    number = np.zeros(len(n), np.int64)
    number[order] = np.arange(len(order))
    term, first = numbered(w)
    pair, tf = np.unique(term * len(order) + np.repeat(number, n), return_counts=True)
    of, doc = np.divmod(pair, len(order))
    sizes = np.bincount(of, minlength=len(first))
    m = 100 - 90 + (90 * n[order].astype(np.int64) * documents) // terms
    impacts = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 8 * m[doc])
    ends, blocks = cut(impacts, sizes, cost, widest)
    start = np.repeat(np.cumsum(sizes) - sizes, blocks) + ends
    tops = np.maximum.reduceat(impacts, np.concatenate([[0], start[:-1]]))
    length = (w.end - w.start)[first]
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    names = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(w.data[spans(w.start[first], length)])])
    ids = ids.take(pa.array(order))
    none = ids.is_null().to_numpy(zero_copy_only=False)
    own = [pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()]), pa.array([none.tobytes()]), pa.array([b""]), pa.array([b""])]
    lists = [_binary(doc, sizes), _binary(impacts, sizes), _binary(ends, blocks), _binary(tops, blocks)]
    rows = len(first) + 1
    columns = [pa.array(np.full(rows, shard, np.int64)), pa.concat_arrays([names, pa.array([None], pa.string())]), pa.array(np.append(sizes, len(order)).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns + [pa.concat_arrays([x, y.cast(pa.binary())]) for x, y in zip(lists, own, strict=True)], names=["shard", "term", "df", *LIST])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 4 << 20, cost: int = 1 << 21, widest: int = 64) -> DataFrame:
    """The index of every row, written to the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    documents, terms = statistics(docs, text_col)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(_words.slices(batches, "text", unit)):
            rows = postings(b.column(1), b.column(0), (part << 32) + k, documents, terms, cost, widest)
            if rows is not None:
                for a in range(0, rows.num_rows, 4096):
                    yield rows.slice(a, 4096)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _store.materialize(narrow.mapInArrow(run, INDEX), "lexical-index")


class Shard:
    """Lists of one shard, for the terms of one block of queries."""

    def __init__(self, lists: pa.Table, ids: bytes, none: bytes):
        self.id, self.none = np.frombuffer(ids, "<i8"), np.frombuffer(none, bool)
        flat = {}
        for c in LIST:
            column = lists[c].combine_chunks()
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            flat[c] = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int32), (at - at[0]) // 4
        self.docs, self.impacts = flat["docs"][0], flat["impacts"][0]
        ends, self.first_block = flat["ends"]
        self.tops = flat["tops"][0].astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), np.diff(self.first_block))
        end = ends + flat["docs"][1][self.row]
        self.start = np.concatenate([[0], end[:-1]])  # lists lie end to end, and so do their blocks
        self.size = end - self.start
        self.low, self.high = self.docs[self.start].astype(np.int64), self.docs[end - 1].astype(np.int64)

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best, and perhaps of others that equal the last."""
        lo, hi = self.first_block[rows], self.first_block[rows + 1]
        block = spans(lo, hi - lo)
        weight = np.repeat(weights, hi - lo)
        bound, low, high = self.tops[block] * weight, self.low[block], self.high[block]
        place = np.concatenate([low, high + 1])
        order = np.argsort(place, kind="stable")
        place, total = place[order], np.cumsum(np.concatenate([bound, -bound])[order])
        wide = np.flatnonzero((place[1:] > place[:-1]) & (total[:-1] > 0))
        bounds, frm, to = total[wide], place[wide], place[wide + 1]
        turn = np.argsort(-bounds, kind="stable")
        bounds, frm, to = bounds[turn], frm[turn], to[turn]
        reached = np.cumsum(to - frm)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, done, some = 1, 0, 8 * k
        while done < len(bounds):
            live = int(np.searchsorted(-bounds, -least, "right"))  # bounds fall: what follows can't reach the k-th best
            step = int(np.searchsorted(reached, (reached[done - 1] if done else 0) + some, "left")) + 1
            stop = min(live, step)
            if stop <= done:
                break
            taken = np.zeros(len(self.id) + 1, np.int8)
            taken[frm[done:stop]] += 1
            np.subtract.at(taken, to[done:stop], 1)
            taken = np.cumsum(taken[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(taken)])
            touched = np.flatnonzero(before[high + 1] > before[low])
            size = self.size[block[touched]]
            at = spans(self.start[block[touched]], size)
            here = taken[self.docs[at]]
            at, w = at[here], np.repeat(weight[touched], size)[here]
            total = np.zeros(len(self.id), np.int64)
            np.add.at(total, self.docs[at], w * self.impacts[at])
            hit = np.flatnonzero(total >= least)
            docs, scores = np.concatenate([docs, hit]), np.concatenate([scores, total[hit]])
            if len(scores) >= k:
                least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= least
                docs, scores = docs[keep], scores[keep]
            done, some = stop, 4 * some
        return docs, scores


def _rank(k: int):
    schema = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(lists: pa.Table, own: pa.Table) -> pa.Table:
        if not (lists.num_rows and own.num_rows):
            return schema.empty_table()
        shard = Shard(lists, own["ids"][0].as_py(), own["none"][0].as_py())
        asked = lists["asked"].combine_chunks()
        row = np.repeat(np.arange(len(lists)), asked.value_lengths().to_numpy(zero_copy_only=False))
        query, weight = asked.flatten().to_numpy(), lists["weight"].to_numpy()
        order = np.argsort(query, kind="stable")
        query, row = query[order], row[order]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(query)), strict=True):
            docs, scores = shard.search(row[a:b], weight[row[a:b]], k)
            ids, none = shard.id[docs], shard.none[docs]
            best = np.lexsort((ids, none, -scores))[:k]
            out.append((np.full(len(best), query[a]), ids[best], none[best], scores[best]))
        q, ids, none, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([pa.array(q), pa.array(ids, mask=none), pa.array(scores)], schema=schema)

    return run


def search(index: DataFrame, queries: DataFrame, documents: int, k: int = 10, id_col: str = "item_id", text_col: str = "text", query_rows: int = 200_000) -> DataFrame:
    """``id_col, rank, doc_id, score`` of the ``k`` best documents of every query; ``documents``: as ``statistics`` counts them."""
    spark = index.sparkSession
    ship(spark)

    def split(batches):
        for b in _words.slices(batches, "text"):
            w = found_terms(b.column(1))
            if len(w.start):
                at = np.repeat(b.column(0).to_numpy(), np.diff(w.doc))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)], pa.string())], names=["q", "term"])

    asked = _store.materialize(queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "lexical-queries")
    terms = _store.materialize(asked.select("q", "text").mapInArrow(split, "q long, term string").distinct(), "lexical-terms")
    blocks = max(1, -(-terms.count() // query_rows))
    lists = index.filter(F.col("term").isNotNull())
    known = lists.select("term", "df").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * documents + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    wanted = terms.join(known, "term").withColumns({"weight": weight, "part": F.pmod(F.xxhash64("q"), F.lit(blocks))})
    wanted = wanted.groupBy("part", "term", "weight").agg(F.collect_list("q").alias("asked"))
    wanted = _store.materialize(wanted, "lexical-wanted")
    parts = _store.partitions(spark)
    met = lists.join(wanted, "term").repartition(parts, "shard", "part")
    own = index.filter(F.col("term").isNull()).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    own = own.select(F.col("shard").alias("of"), F.col("part").alias("asker"), F.col("docs").alias("ids"), F.col("impacts").alias("none")).repartition(parts, "of", "asker")
    best = met.groupBy("shard", "part").cogroup(own.groupBy("of", "asker")).applyInArrow(_rank(k), "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("q", F.col("id").alias(id_col)), "q").select(id_col, "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents")
    with _store.scratch(spark) as keep:
        index = build(docs)
        documents = index.filter(F.col("term").isNull()).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        return keep(_store.materialize(search(index, _store.table(spark, sf_dir, "benchmark"), documents), "lexical-best"))


ORACLE_SQL = {
    "op12_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id,
         list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
q AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
t AS (SELECT DISTINCT q, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM q),
r AS (
  SELECT q, tf.d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(terms) * docs) // total)))) AS BIGINT) AS score
  FROM t JOIN w USING (term) JOIN tf USING (term) JOIN d ON d.d = tf.d, s GROUP BY q, tf.d),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r JOIN d USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN q USING (q) WHERE rank <= 10
""",
}
