"""N-gram Jaccard self-join by chosen paths (operator 8).

Documents whose sets of word shingles have a Jaccard similarity of
``threshold`` or more are linked.  In each of ``runs`` independent runs a set
follows, at every level, the tokens whose hash along the path falls below
``1 / (threshold * size)``: about ``1 / threshold`` of them, and similar sets
choose the same ones.  Sets on the same path form a bucket; a small bucket is
compared pair by pair, a large one whose sets are alike on average is compared
in blocks, one of up to ``middle`` sets that aren't is compared by sketches, and
any other is split again.  ``runs`` follows from the wanted recall at two
levels; sets that were split further go through as many runs more, among
themselves, as the deepest level needs.  Every candidate is confirmed by its exact similarity.

How it scales.

* Texts of equal shingle sets are one *class* (``cid``) from the start, so a
  group of copies is one member however many it has; paths are made distinct
  with map-side aggregation before they are shuffled.
* Token sets are written once; only sets that share a path with another one
  are joined again.
* Average likeness of a large bucket comes from 128 bit sums of one-bit minhash
  sketches: one aggregation, no pairs.  The sketch also rejects candidates far
  below the threshold (more than five deviations), natively.
* Dense buckets are dealt to pairs of blocks.  A block pair is one matrix
  product; it gives back link counts and a spanning forest, not pairs, and a
  pair that several dense buckets hold is counted in the least of them alone.
* Components come from minimum labels with pointer jumping over that forest.
* Nothing is capped: a bucket that can't be split is compared in full.

Shingles are kept as 32-bit hashes for the exact similarity.  Defined cases:
null or blank texts have no shingles and are linked to nothing, each a class of
its own; texts of fewer words than a shingle have one shingle, all their words;
a null id is allowed, and ranks after others; rows of equal id stay rows; an
empty table gives an empty one.  Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import _store, _words
from ._words import U, mix

BITS = 128
_MULT = (np.random.default_rng(8).integers(0, 1 << 31, BITS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SETS = "doc_id long, text_hash long, cid long, n int, tokens binary, k0 long, k1 long, paths array<long>"


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and where each document's begin (and the end)."""
    w = _words.words(column)
    per = np.diff(w.doc)
    at, (h,) = w.windows(size)
    doc = np.searchsorted(w.doc, at, "right") - 1
    few = np.flatnonzero((per > 0) & (per < size))
    extra = np.zeros(len(few), U)
    for i, d in enumerate(few.tolist()):  # short texts: all their words
        for k in range(w.doc[d], w.doc[d + 1]):
            extra[i] = mix(extra[i : i + 1] + w.hash[k : k + 1], int(per[d]))[0]
    doc, h = np.r_[doc, few], np.r_[h, extra]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[fresh], h[fresh]
    return h, np.searchsorted(doc, np.arange(len(per) + 1))


def sketch(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One-bit minhashes of each nonempty set, as (sets, 2) signed longs."""
    out = np.zeros((len(begin), 2), U)
    buf = np.empty(len(tokens), np.uint32)
    for i in range(BITS):
        np.multiply(tokens, _MULT[i], out=buf)
        least = np.minimum.reduceat(buf, begin)
        bit = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
        out[:, i >> 6] |= bit.astype(U) << U(i & 63)
    return out.view(np.int64)


def _first_level(size: int, threshold: float, runs: int):
    def run(batches):
        for b in _words.slices(batches, "text", 2 << 20):
            h, begin = shingle_sets(b.column(1), size)
            n = np.diff(begin)
            has = np.flatnonzero(n)
            tokens = (h >> U(32)).astype(np.uint32)
            cid, sk = np.zeros(len(n), np.int64), np.zeros((len(n), 2), np.int64)
            paths_of: list[np.ndarray] = []
            doc = np.repeat(np.arange(len(n)), n)
            if len(has):
                total = np.add.reduceat(mix(h, 3), begin[has]) ^ mix(np.add.reduceat(mix(h, 5), begin[has]) + n[has].astype(U))
                cid[has] = mix(total).view(np.int64)
                sk[has] = sketch(tokens, begin[has])
                limit = np.minimum(2.0**32 / (threshold * np.maximum(n, 1)), 2.0**32 - 1).astype(np.uint32)
                limit = np.repeat(limit, n)
                low = h & U(0xFFFFFFFF)
                for r in range(runs):
                    odd = U(((r * 2 + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
                    pick = np.flatnonzero(((low * odd) >> U(32)).astype(np.uint32) <= limit)
                    paths_of.append(np.stack([doc[pick], mix(h[pick], 100 + r).view(np.int64)]))
            both = np.concatenate(paths_of, axis=1) if paths_of else np.zeros((2, 0), np.int64)
            order = np.argsort(both[0], kind="stable")
            cuts = np.searchsorted(both[0][order], np.arange(len(n) + 1))
            paths = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(both[1][order]))
            # sorted as 32-bit values within each set, since tokens are the upper halves of sorted hashes
            blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((begin * 4).astype(np.int32)), pa.py_buffer(tokens)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cid), pa.array(n.astype(np.int32)), blobs, pa.array(sk[:, 0].copy()), pa.array(sk[:, 1].copy()), paths], names=["doc_id", "text_hash", "cid", "n", "tokens", "k0", "k1", "paths"])

    return run


def _children(threshold: float):
    def run(batches):
        for b in batches:
            path, cid, n = (b.column(i).to_numpy() for i in range(3))
            out = []
            for i, t in enumerate(b.column(5)):
                tok = np.frombuffer(t.as_buffer(), np.uint32).astype(U)
                own = path[i : i + 1].view(U)
                h = mix(tok ^ own, 7)
                out.append(mix(h[(h >> U(32)) <= U(int(min(2.0**32 / (threshold * n[i]), 2.0**32 - 1)))], 9).view(np.int64))
            per = np.array([len(x) for x in out])
            rep = np.repeat(np.arange(len(out)), per)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), pa.array(cid[rep]), *(b.column(i).take(pa.array(rep)) for i in (2, 3, 4))], names=["path", "cid", "n", "k0", "k1"])

    return run


def _sketch_pairs(threshold: float, most: int):
    """Pairs of a bucket whose sketches and sizes allow the threshold."""

    def run(t: pa.Table) -> pa.Table:
        cid, n = t.column("cid").to_numpy(), t.column("n").to_numpy().astype(float)
        k0, k1 = (t.column(c).to_numpy().view(U) for c in ("k0", "k1"))
        a, b = [], []
        for i in range(len(cid) - 1):
            far = np.bitwise_count(k0[i] ^ k0[i + 1 :]) + np.bitwise_count(k1[i] ^ k1[i + 1 :])
            rest = n[i + 1 :]
            j = i + 1 + np.flatnonzero((far <= most) & (np.minimum(n[i], rest) >= threshold * np.maximum(n[i], rest) - 1e-9))
            a.append(np.full(len(j), cid[i]))
            b.append(cid[j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _alike(a, na, b, nb, threshold: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (na + nb - both) - 1e-9


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            ts, us = b.column(2), b.column(3)
            keep = [_alike(x := np.frombuffer(t.as_buffer(), np.uint32), len(x), y := np.frombuffer(u.as_buffer(), np.uint32), len(y), threshold) for t, u in zip(ts, us, strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _block_pair(threshold: float):
    """Links within a pair of blocks of a dense bucket: counts per set, and a spanning forest."""

    def run(t: pa.Table) -> pa.Table:
        path, i, j = (t.column(c)[0].as_py() for c in ("path", "i", "j"))
        order = np.lexsort((t.column("cid").to_numpy(), t.column("block").to_numpy()))
        t = t.take(pa.array(order)).combine_chunks()
        cid, block = t.column("cid").to_numpy(), t.column("block").to_numpy()
        toks = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("tokens")]
        n = np.array([len(x) for x in toks])
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        links, edges = np.zeros(len(cid), np.int64), []
        if len(left) and len(right):
            allowed = np.ones((len(left), len(right)), bool) if i != j else np.triu(np.ones((len(left), len(left)), bool), 1)
            lists = t.column("dense").to_pylist()
            for e in sorted({x for xs in lists for x in xs if x < path}):  # counted in that bucket
                m = np.array([e in xs for xs in lists])
                allowed &= ~(m[left][:, None] & m[right][None, :])
            if allowed.any():
                # tokens that two sets of the pair of blocks have, as columns
                lt, rt = np.concatenate([toks[k] for k in left]), np.concatenate([toks[k] for k in right])
                if i == j:
                    common, times = np.unique(lt, return_counts=True)
                    common = common[times > 1]
                else:
                    common = np.intersect1d(lt, rt)
                both = np.zeros((len(left), len(right)), np.float32)
                for c in range(0, len(common), 4096):
                    part = common[c : c + 4096]
                    sides = []
                    for rows, flat in ((left, lt), (right, rt)):
                        who = np.repeat(np.arange(len(rows)), n[rows])
                        at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
                        ok = part[at] == flat
                        m = np.zeros((len(rows), len(part)), np.float32)
                        m[who[ok], at[ok]] = 1
                        sides.append(m)
                    both += sides[0] @ sides[1].T
                hit = allowed & (both >= threshold * (n[left][:, None] + n[right][None, :] - both) - 1e-6)
                np.add.at(links, left, hit.sum(1))
                np.add.at(links, right, hit.sum(0))
                parent = list(range(len(cid)))

                def root(x):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for a, row in zip(left.tolist(), hit, strict=True):
                    ra = root(a)
                    for b in right[np.flatnonzero(row)].tolist():
                        rb = root(b)
                        if rb != ra:
                            parent[rb] = ra
                            edges.append((cid[a], cid[b]))
        some = np.flatnonzero(links)
        k = len(edges)
        return pa.table({"cid": np.r_[cid[some], np.array([a for a, _ in edges], np.int64)], "other": pa.array([None] * len(some) + [int(b) for _, b in edges], pa.int64()), "links": np.r_[links[some], np.zeros(k, np.int64)]})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex of each vertex's component."""
    both = _store.materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = _store.materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "v"), "cc-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", "root", F.least("root", "near").alias("new"))
        jump = step.select(F.col("v").alias("jv"), F.col("new").alias("jump"))
        after = step.join(jump, F.col("new") == F.col("jv"), "left").select("v", F.least("new", F.coalesce("jump", "new")).alias("root"), F.col("root").alias("was"))
        after = _store.materialize(after, "cc-labels")
        if after.filter(F.col("root") != F.col("was")).isEmpty():
            return after.select("v", "root")
        labels = after.select("v", "root")


def runs_for(recall: float, threshold: float, depth: int = 2) -> int:
    """Runs that find a pair at the threshold with probability ``recall`` if it takes ``depth`` levels."""
    shared = 2 * threshold / (1 + threshold) / threshold  # common tokens that both sets choose, expected
    once = (1 - math.exp(-shared)) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def runs_within(recall: float, levels: int) -> int:
    """Runs that find a pair with probability ``recall`` if its common path has ``levels`` tokens, for the pairs that share fewest: of sets of which one contains the other.

    They choose one common token on average (a Poisson number), at each level
    and for each path they have in common.
    """
    once = 1.0
    for _ in range(levels):
        once = 1 - math.exp(-once)
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def join(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999, limit: int = 24, middle: int = 1024, block: int = 768, dense: float = 0.2, depth: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id`` (least id linked to it, directly or not), ``n_links`` (different texts linked directly), ``n_copies`` (rows of equal shingles).

    Besides ``text_hash``, and ``root``, which is the same for all rows of a class and null for rows without words.
    """
    spark = docs.sparkSession
    ship(spark)
    with _store.scratch(spark) as keep:  # of all the tables on the way one is left
        runs = runs_for(recall, threshold)
        out = _join(docs, threshold, size, runs, max(0, runs_within(recall, depth + 1) - runs), limit, middle, block, dense, depth, id_col, text_col)
        return keep(_store.materialize(out, "jaccard-classes"))


def _join(docs: DataFrame, threshold: float, size: int, runs: int, more: int, limit: int, middle: int, block: int, dense: float, depth: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    sets = _store.materialize(rows.mapInArrow(_first_level(size, threshold, runs), _SETS), "shingle-sets")
    member = ["path", "cid", "n", "k0", "k1"]
    # Copies follow the same paths: distinct() folds them before the shuffle.
    level = sets.filter(F.col("n") > 0).select(F.explode("paths").alias("path"), "cid", "n", "k0", "k1").distinct()
    needed, pairs, dense_members, deep = None, [], [], []

    def follow(level):
        nonlocal needed
        for d in range(depth + 1):
            counts = level.groupBy("path").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
            level = _store.materialize(level.join(counts, "path").select(*member, "m"), "level")
            if needed is None:
                ids = level.select("cid").distinct()
                needed = _store.materialize(sets.select("cid", "tokens").join(ids, "cid", "left_semi").groupBy("cid").agg(F.min("tokens").alias("tokens")), "needed-sets")
            small = level.filter(F.col("m") <= limit)
            a, b = small.select("path", *(F.col(c).alias(c + "_a") for c in member[1:])), small.select("path", *(F.col(c).alias(c + "_b") for c in member[1:]))
            far = F.bit_count(F.col("k0_a").bitwiseXOR(F.col("k0_b"))) + F.bit_count(F.col("k1_a").bitwiseXOR(F.col("k1_b")))
            # expected distance at the threshold, and five deviations more
            p = (1 - threshold) / 2
            most = math.ceil(BITS * p + 5.5 * math.sqrt(BITS * p * (1 - p)))
            near = (far <= most) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
            pairs.append(a.join(b, "path").filter((F.col("cid_a") < F.col("cid_b")) & near).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")))
            large = level.filter(F.col("m") > limit)
            if large.isEmpty():
                break
            bit = lambda i: F.sum(F.shiftrightunsigned(F.col(f"k{i >> 6}"), i & 63).bitwiseAND(1)) / F.count(F.lit(1))
            like = large.groupBy("path").agg(F.array(*(bit(i) for i in range(BITS))).alias("p"))
            mean = F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x + (1 - x) * (1 - x)) / BITS  # share of equal bits over all pairs
            like = _store.materialize(like.select("path", ((2 * mean - 1 >= dense) | F.lit(d == depth)).alias("alike")), "level-alike")
            judged = _store.materialize(large.join(like, "path"), "level-large")
            dense_members.append(judged.filter("alike").select("path", "cid", "m"))
            pairs.append(judged.filter(~F.col("alike") & (F.col("m") <= middle)).groupBy("path").applyInArrow(_sketch_pairs(threshold, most), "a long, b long"))
            rest = judged.filter(~F.col("alike") & (F.col("m") > middle)).select(*member)
            if rest.isEmpty():
                break
            if d:
                deep.append(rest.select("cid"))
            level = rest.join(needed, "cid").select(*member, "tokens").mapInArrow(_children(threshold), "path long, cid long, n int, k0 long, k1 long").distinct()

    follow(level)
    if deep and more:
        # Sets that were split beyond two levels may have missed each other there: further runs, among these alone
        again = deep[0]
        for x in deep[1:]:
            again = again.union(x)
        again = _store.materialize(again.distinct(), "deep-sets")
        first = sets.join(again, "cid", "left_semi").groupBy("cid").agg(*(F.min(c).alias(c) for c in ("n", "k0", "k1", "tokens")))
        first = first.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(more)))).withColumn("path", F.xxhash64("path"))
        follow(first.select(*member, "tokens").mapInArrow(_children(threshold), "path long, cid long, n int, k0 long, k1 long").distinct())
    found = pairs[0]
    for x in pairs[1:]:
        found = found.union(x)
    found = found.distinct()
    counts, edges = [], []
    if dense_members:
        inside = dense_members[0]
        for x in dense_members[1:]:
            inside = inside.union(x)
        inside = _store.materialize(inside.distinct(), "dense")
        lists = _store.materialize(inside.groupBy("cid").agg(F.array_sort(F.collect_set("path")).alias("dense")), "dense-lists")
        for side in ("a", "b"):
            found = found.join(lists.select(F.col("cid").alias(side), F.col("dense").alias(f"dense_{side}")), side, "left")
        found = found.filter(~F.coalesce(F.arrays_overlap("dense_a", "dense_b"), F.lit(False))).select("a", "b")
        blocks = F.ceil(F.col("m") / block).cast("int")
        dealt = inside.join(lists, "cid").join(needed, "cid").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), blocks).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "tokens", "dense")
        out = _store.materialize(dealt.groupBy("path", "i", "j").applyInArrow(_block_pair(threshold), "cid long, other long, links long"), "dense-links")
        edges.append(out.filter(F.col("other").isNotNull()).select(F.col("cid").alias("a"), F.col("other").alias("b")))
        counts.append(out.filter(F.col("links") > 0).select("cid", "links"))
    found = found.join(needed.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a").join(needed.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")
    linked = _store.materialize(found.mapInArrow(_verify(threshold), "a long, b long"), "links")
    edges.append(linked)
    counts += [linked.select(F.col(x).alias("cid"), F.lit(1).cast("long").alias("links")) for x in ("a", "b")]
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].union(union(xs[1:]))
    roots = components(union(edges)).withColumnRenamed("v", "cid")
    links = union(counts).groupBy("cid").agg(F.sum("links").alias("n_links"))
    texts = sets.filter(F.col("n") > 0).groupBy("cid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    classes = texts.join(roots, "cid", "left").join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    classes = _store.materialize(classes, "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = classes.join(least, "root").select("cid", "root", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = sets.select("doc_id", "text_hash", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(classes, "cid", "left")
    return out.select("doc_id", "text_hash", "root", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = join(_store.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "n_links", "n_copies")


#: The same by counting common shingles of all pairs that have one; DuckDB SQL.
ORACLE_SQL = {
    "op8_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda k: array_to_string(w[k : k + 4], ' ')))) END AS s FROM d),
sets AS (SELECT min(doc_id) AS rep, count(*) AS n_copies, s FROM g WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM sets),
link AS (SELECT a.rep AS a, b.rep AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep HAVING count(*) >= 0.8 * (min(a.n) + min(b.n) - count(*)) - 1e-9),
reach AS (SELECT rep AS a, rep AS b FROM sets WHERE rep IN (SELECT a FROM link) UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a AS rep, count(*) AS n FROM link GROUP BY a)
SELECT g.doc_id, coalesce(least.class_id, sets.rep, g.doc_id) AS class_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, CAST(coalesce(sets.n_copies, 1) AS BIGINT) AS n_copies
FROM g LEFT JOIN sets ON g.s = sets.s LEFT JOIN least ON sets.rep = least.rep LEFT JOIN degree ON sets.rep = degree.rep
"""
}
