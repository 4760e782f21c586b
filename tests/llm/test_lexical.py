"""Lexical search against counting every document, block bounds against all cuts."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pulseframe.llm import _words, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def brute(docs, queries, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    count, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in queries:
        found = []
        for i, b, n in bags:
            m = 100 - 90 + (90 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def run(spark, docs, queries, k=10, query_rows=200_000, **options):
    d = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in docs], "doc_id long, text string, df int, term string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in queries], "item_id long, text string, rank int, q int")
    count, total = lexical.statistics(d)
    index = lexical.build(d, **options)
    assert not count or count == sum(bool(terms(t)) for _, t in docs)
    assert total == sum(len(terms(t)) for _, t in docs)
    return sorted(map(tuple, lexical.search(index, q, count, k, query_rows=query_rows).collect()), key=repr)


@pytest.fixture(scope="module")
def prose():
    r = np.random.default_rng(1)
    word = lambda: f"w{int(r.zipf(1.3)) % 400}"
    docs = [(i, " ".join(word() for _ in range(int(r.integers(1, 120))))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(60)]  # copies, and ties
    return docs, [(i, " ".join(word() for _ in range(12))) for i in range(25)] + [(99, docs[7][1])]


@pytest.mark.parametrize("options", [{}, {"unit": 3000, "cost": 200_000}, {"unit": 9000, "cost": 0, "widest": 3}, {"unit": 20_000, "query_rows": 40, "k": 3}])
def test_brute_force(spark, prose, options):
    docs, queries = prose
    assert run(spark, docs, queries, **options) == brute(docs, queries, options.get("k", 10))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " -- !\t"), (4, "Straße ÉTÉ été_x1 日本 語 \x1c"), (5, "STRASSE straße ETE"), (6, "a " * 40_000 + "b"), (7, "b"), (7, "b"), (None, "b"), (8, "b"), (-3, "b")]
    queries = [(1, None), (2, "..."), (3, "nowhere"), (4, "B b b"), (5, "STRAßE été 日本"), (None, "x1 ete"), (4, "B b b")]
    for options in ({}, {"unit": 1}, {"k": 4}):
        assert run(spark, docs, queries, **options) == brute(docs, queries, options.get("k", 10))


def test_nothing(spark):
    assert run(spark, [], [(1, "a")]) == [] == run(spark, [(1, "a")], []) == run(spark, [(1, "")], [(1, "a")])


def best_cost(x, cost, widest):
    best = [0] + [None] * len(x)
    for e in range(1, len(x) + 1):
        best[e] = min(best[s] + cost + max(x[s:e]) * (e - s) - sum(x[s:e]) for s in range(max(0, e - widest), e))
    return best[-1]


@pytest.mark.parametrize("cost,widest", [(0, 5), (40, 5), (300, 64), (10**9, 7)])
def test_blocks_cost_least(cost, widest):
    r = np.random.default_rng(2)
    lists = [r.integers(0, 100, int(n)) for n in [*r.integers(1, 40, 60), 1, 1, 90]]
    ends, counts = lexical.cut(np.concatenate(lists).astype(np.int64), np.array([len(x) for x in lists]), cost, widest)
    at = 0
    for x, n in zip(lists, counts, strict=True):
        own = ends[at : at + n]
        at += n
        assert own[-1] == len(x) and np.diff(own, prepend=0).min() >= 1 and np.diff(own, prepend=0).max() <= widest
        got = sum(cost + x[s:e].max() * (e - s) - x[s:e].sum() for s, e in zip([0, *own[:-1]], own, strict=True))
        assert got == best_cost(x.tolist(), cost, widest)


def test_one_hash_for_two_terms():
    w = lexical.found_terms(pa.array(["ab cd Ab CD ef", "cd"]))
    w.hash[:] = [1, 1, 1, 1, 2, 1]
    number, first = lexical.numbered(w)
    names = [w.data[w.start[f] : w.end[f]].tobytes().decode() for f in first]
    assert [names[n] for n in number] == ["ab", "cd", "ab", "cd", "ef", "cd"]


def test_blocks_are_skipped(prose):
    """A search reads a part of the postings only."""
    docs, queries = prose
    ids = pa.array([i for i, _ in docs] * 20)
    texts = pa.array([t if k % 20 else t + " rare" * 3 for k, (_, t) in enumerate(docs * 20)])
    rows = pa.Table.from_batches([lexical.postings(texts, ids, 0, len(ids), sum(len(terms(t.as_py())) for t in texts), 1 << 21, 64)])
    lists, own = rows.slice(0, rows.num_rows - 1), rows.slice(rows.num_rows - 1)
    shard = lexical.Shard(lists, own["docs"][0].as_py(), own["impacts"][0].as_py())
    read = []
    inner = lexical.spans
    names = lists["term"].to_pylist()
    want = [names.index(t) for t in ("rare", "w1", "w2", "w3")]
    df = lists["df"].to_numpy()[want]
    weights = np.floor(1000 * np.log((2 * len(ids) + 2) / (2 * df + 1))).astype(np.int64)
    lexical.spans = lambda s, n: read.append(int(n.sum())) or inner(s, n)
    try:
        docs_found, scores = shard.search(np.array(want), weights, 10)
    finally:
        lexical.spans = inner
    assert sum(read[1:]) < 0.6 * df.sum()
    full = np.zeros(len(shard.id), np.int64)
    for t, w in zip(want, weights, strict=True):
        a, b = shard.start[shard.first_block[t]], shard.start[shard.first_block[t]] + shard.size[shard.first_block[t] : shard.first_block[t + 1]].sum()
        full[shard.docs[a:b]] += w * shard.impacts[a:b]
    least = np.sort(full)[-10]
    assert sorted(scores.tolist()) == sorted(full[full >= least].tolist())
    assert _words.words(pa.array(["A b"])).data.tobytes() == b"A b"
