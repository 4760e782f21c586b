"""Packing's cost where documents lead nowhere, and that its short cuts change nothing."""

import time

import numpy as np
import pytest

from pulseframe.llm import packing

END = 1


def shard(docs):
    return packing.Shard(np.concatenate([[*d, END] for d in docs]).astype(np.int64), np.array([len(d) + 1 for d in docs]), 2048, END)


@pytest.mark.parametrize("name", ["no terms", "own terms", "pairs", "one word"])
def test_many_small_documents(name):
    n = 200_000 if name == "no terms" else 60_000
    docs = {"no terms": lambda i: [], "own terms": lambda i: [2 + i % 65_000], "pairs": lambda i: [2 + i // 2], "one word": lambda i: [7]}[name]
    own = shard([docs(i) for i in range(n)])
    began = time.perf_counter()
    pieces = own.pack()
    assert time.perf_counter() - began < 5
    assert sorted(p[0] for p in pieces if p[1] == 0) == list(range(n))


def slow_neighbours(ids, unused, doc, size):
    """BM25 over all unused documents, from its formula."""
    n, mean = len(ids), np.mean(size)
    terms = [set(d) - {END} for d in ids]
    df = {t: sum(t in x for x in terms) for t in terms[doc]}
    out = []
    for k in range(n):
        if unused[k] and k != doc:
            s = 0.0
            for t in terms[doc] & terms[k]:
                tf = ids[k].count(t)
                s += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * size[k] / mean))
            if s > 0:
                out.append((k, s))
    return out


@pytest.mark.parametrize("spread", [9, 60, 400])
def test_neighbours_are_those_of_the_formula(spread):
    r = np.random.default_rng(spread)
    docs = [r.integers(2, 2 + spread, int(r.integers(0, 12))).tolist() for _ in range(80)]
    own = shard(docs)
    ids, size = [[*d, END] for d in docs], [len(d) + 1 for d in docs]
    for doc in r.permutation(80)[:50].tolist():
        own.use(doc)
        want = dict(slow_neighbours(ids, own.unused, doc, size))
        got = list(own.neighbours(doc, own.unused))
        assert sorted(got) == sorted(want)
        scores = [want[k] for k in got]
        assert all(a >= b - 1e-4 for a, b in zip(scores, scores[1:], strict=False))
    for doc in np.flatnonzero(own.unused).tolist():
        own.use(doc)
    assert not own.left.any() and not any(list(own.neighbours(d, own.unused)) for d in range(80))
