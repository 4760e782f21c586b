"""Operators against plain versions of their definitions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import _bpe, decontam, html, jaccard, licenses, lm, packing, quality, sharding, substring, tokencount

P = pytest.importorskip("public_tokenizers")


def grams(w, k):
    return list(zip(*[w[i:] for i in range(k)], strict=False))


def test_substring(spark, sf_dir, texts, words):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op4_substring_dedup(spark, sf_dir).collect()}
    seen = set()
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for k, g in enumerate(grams(w, 20)):
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        kept = " ".join(a for a, b in zip(w, gone, strict=True) if not b)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(v[1] for v in got.values()) > 0


def test_substring_spans_and_many_chunks(docs, texts):
    few = {r.doc_id: (r.n_removed, r.kept_text, [(s["from"], s["to"]) for s in r.spans]) for r in substring.remove_repeats(docs).collect()}
    many = {r.doc_id: (r.n_removed, r.kept_text, [(s["from"], s["to"]) for s in r.spans]) for r in substring.remove_repeats(docs, chunk_bytes=20_000).collect()}
    assert few == many
    assert all(sum(b - a for a, b in v[2]) == v[0] for v in few.values())


def test_dealing_over_levels_of_buckets(docs):
    """Three levels of buckets give what one gives, and the rows that are sent grow as the chunks do."""
    plain = lambda out: {(r.doc_id, r.n_removed, r.kept_text) for r in out.collect()}
    assert plain(substring.remove_repeats(docs)) == plain(substring.remove_repeats(docs, chunk_bytes=20_000, fan=4))
    scores = lambda **k: {r.doc_id: (r.n_words, round(r.log_score, 6), r.n_full, r.n_backed_off, r.n_unseen) for r in lm.score(docs, **k).collect()}
    assert scores() == scores(chunk_bytes=60_000, fan=4)
    size = sum(len((r.text or "").encode()) for r in docs.select("text").collect())
    for chunk in (80_000, 40_000, 20_000):
        levels, deal = [], substring._store.deal

        def counted(df, *a, levels=levels, deal=deal, **k):
            levels.append([r["count"] for r in df.groupBy("p").count().collect()])
            return deal(df, *a, **k)

        substring._store.deal = counted
        try:
            substring.remove_repeats(docs, chunk_bytes=chunk, fan=4)
        finally:
            substring._store.deal = deal
        assert all(max(n) <= 4 and len(n) <= 4 * -(-size // chunk) for n in levels)
        assert len(levels) <= 1 + math.ceil(math.log(max(1, size / chunk), 4))


def test_rows_without_ids_are_dealt_apart(spark, docs):
    few = docs.select("doc_id", "text").limit(60).withColumn("doc_id", F.lit(None).cast("long"))
    placed = few.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)).alias("p")).groupBy("p").count().collect()
    assert len(placed) > 8
    assert lm.score(few, chunk_bytes=20_000).count() == 60 and substring.remove_repeats(few, chunk_bytes=20_000).count() == 60


def test_token_counts(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.op2_token_counts(spark, sf_dir).collect()}
    for i, x in texts.items():
        n = len(t.encode(x or "", add_special_tokens=False))
        assert got[i] == (len((x or "").encode()), n, n > 1024)


def test_token_splices(texts):
    c = tokencount.Counter(P.path("byte_bpe_50k.json"), huge=1000, chunk=700, overlap=64)
    plain = " ".join(texts[i] for i in sorted(texts)[:40])
    hard = ["a<|endoftext|>b <|endoftext|> c\n<|endoftext|>  d " * 60, "x" * 5000, "日本語 テキスト" * 300, " " * 3000 + "a", "don't I'LL  12 345\t!!! " * 90, plain.replace(" ", ""), plain]
    for t in hard:
        assert c.spliced(t) == c.whole(t)
        assert c.batch([t])[0] == c.whole(t)


def test_word_bpe(texts):
    w = _bpe.WordBpe(P.path("word_bpe_49k.json"), cache=500)
    odd = ["", "a<|endoftext|>b", "don't I'LL 123 4567 !!! ...", "é́ ΑΣ İstanbul ʃ 日本", "x\x1cy", "aaaa aaaaa aaa", "\u00a0", "\u0085 \u00a0\u00a0  ", "\u00a0a\u00a0 b"]
    for t in odd:  # alone in its batch
        assert np.frombuffer(_bpe.WordBpe(P.path("word_bpe_49k.json")).ids([t.encode()])[0], "<u2").tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids
    for t in [texts[i] for i in sorted(texts)[:80]] + odd:
        assert np.frombuffer(w.ids([t.encode()])[0], "<u2").tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in packing.op7_retrieval_packing(spark, sf_dir).collect():
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, x in texts.items():
        ids, at = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # every sequence is full, or a power of two


def test_neighbours_are_those_of_plain_bm25():
    rng = np.random.default_rng(11)
    docs = [rng.zipf(1.3, rng.integers(3, 80)) % 900 + 2 for _ in range(150)]
    docs += [docs[k].copy() for k in range(0, 150, 3)]
    size = np.array([len(d) for d in docs])
    shard = packing.Shard(np.concatenate(docs).astype("<u2"), size, 2048, 1)
    bags, n = [Counter(d.tolist()) for d in docs], len(docs)
    df = Counter(t for b in bags for t in b)
    weigh = lambda t, b, k: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * (packing.K1 + 1) / (b[t] + packing.K1 * (1 - packing.B + packing.B * k / size.mean()))
    unused = np.ones(n, np.float32)
    unused[5:15] = 0
    for seed in (0, 7, 60, 151):
        want = {x: sum(weigh(t, bags[x], size[x]) for t in bags[seed] if t in bags[x]) for x in range(n) if unused[x]}
        got = list(shard.neighbours(seed, unused))
        assert sorted(got) == sorted(x for x, v in want.items() if v > 0)
        assert all(want[a] >= want[b] - 1e-3 for a, b in zip(got, got[1:], strict=False))


def test_packing_joins_neighbours():
    ids = np.array([5, 6, 7, 8, 9, 10, 20, 21, 22, 23, 5, 6, 7, 8, 9, 11, 20, 21, 22, 24] * 1, "<u2")
    shard = packing.Shard(ids, np.array([6, 4, 6, 4]), 12)
    first = [d for d, *_ in shard.pack()[:2]]
    assert first == [0, 2]


def test_packing_finds_copies_that_are_a_third():
    rng = np.random.default_rng(5)
    copy, docs = rng.integers(2, 50, 40), []
    for k in range(60):
        docs.append(copy if k % 3 == 0 else np.arange(40) + 100 + 40 * k)
    shard = packing.Shard(np.concatenate(docs).astype("<u2"), np.full(60, 40), 800)
    first = [d for d, *_ in shard.pack()[:20]]
    assert first == list(range(0, 60, 3))


def test_packing_uses_whole_queries_and_all_neighbours():
    # even documents share their last tokens, which weigh least of each one's terms; odd ones share nothing
    docs = [np.r_[np.repeat(np.arange(12) + 1000 + 12 * (k // 4 if k % 2 == 0 else 200 + k), 2), [5, 6] if k % 2 == 0 else []] for k in range(120)]
    size = np.array([len(d) for d in docs])
    shard = packing.Shard(np.concatenate(docs).astype("<u2"), size, 60 * 26)
    assert {d for d, *_ in shard.pack()[:60]} == set(range(0, 120, 2))


def test_packing_finds_neighbours_of_other_partitions(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 1 << 30, 60)) for _ in range(40)]
    df = spark.createDataFrame([(k, texts[k % 40]) for k in range(160)], "doc_id long, text string").repartition(8, F.floor(F.col("doc_id") / 40))
    by = defaultdict(set)
    for r in packing.pack(df, shard_tokens=5_000).collect():
        by[r.doc_id % 40].add(r.sequence_id)
    assert np.mean([len(v) for v in by.values()]) < 2.5


def test_sharding(spark, sf_dir, texts):
    rows = sharding.op10_histogram_sharding(spark, sf_dir).collect()
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r)
    assert len(rows) == len(texts) and set(by) <= set(range(16))
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 16) <= 2 * most


def test_sharding_splits_a_group_of_copies(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy " * 10).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    sizes = [r["sum(size)"] for r in sharding.shard(df, 8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 120


def test_quality(spark, sf_dir, texts, words):
    rows = quality.op5_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        g = grams(w, 3)
        n = Counter(g)
        covered = {i + j for i, x in enumerate(g) if n[x] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_keeps_the_good(spark, sf_dir):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in quality.op5_quality_rules(spark, sf_dir).collect() if r.doc_id in good and not r.base_failed]
    assert all(r.kept for r in rows if good[r.doc_id] == 1)
    bad = [r.kept for r in rows if good[r.doc_id] == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_quality_verdict_is_that_of_a_plain_mcd(spark):
    rng = np.random.default_rng(4)
    rows, planted = [], set()
    for g, size in enumerate([1, 3, 8, 40, 300]):
        for k in range(size):
            odd = size >= 40 and k % 5 == 0  # a fifth of each larger group: many symbols, and long words
            w = ["".join(rng.choice(list("abcdefgh"), max(1, int(rng.normal(6 + g % 2 + 9 * odd, 2))))) + "#&" * int(rng.random() < (0.9 if odd else 0.02)) for _ in range(int(rng.integers(60, 140)))]
            planted |= {len(rows)} if odd else set()
            rows.append((len(rows), "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12)), "en" if g % 2 else None, f"s{g}"))
    out = [r.asDict() for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).orderBy("doc_id").collect()]
    share = lambda a, b: math.asin(math.sqrt(min(1.0, a / max(b, 1))))
    lines = [len(t.split("\n")) for _, t, _, _ in rows]
    x = np.array([[math.log(r["word_chars"] / r["n_words"]), share(r["n_symbols"], r["word_chars"]), share(r["n_dup_lines"], n), share(r["n_repeat_words"], r["n_words"])] for r, n in zip(out, lines, strict=True)])
    assert not any(r["base_failed"] for r in out)
    floors, prior = np.array([0.04, 0.045, 0.16, 0.14]), 20.0
    low = lambda v, q: np.sort(v, axis=0)[math.ceil(q * len(v)) - 1]
    m0, c0 = low(x, 0.5), ((low(x, 0.75) - low(x, 0.25)) / 1.349) ** 2

    def shrunk(y, factor):
        n = len(y)
        return (n * y.mean(0) + prior * m0) / (n + prior), (n * factor * np.cov(y.T, bias=True).reshape(4, 4) + prior * np.diag(c0)) / (n + prior) + np.diag(floors**2)

    def far(y, m, c):
        return np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(c), y - m)

    for source in sorted({r["source"] for r in out}):
        at = [i for i, r in enumerate(out) if r["source"] == source]
        y, best = x[at], None
        h = math.ceil(0.75 * len(y))
        for start in range(60):  # random subsets, each concentrated to the end
            own, had = y[rng.choice(len(y), min(len(y), 6), replace=False)], math.inf
            while True:
                m, c = shrunk(own, quality.CONSISTENT)
                det = np.linalg.slogdet(c)[1]
                if start and det >= had - 1e-9 and len(own) == h:
                    break
                if not start and had == det:
                    break
                had, own = det, y[np.argsort(far(y, m, c), kind="stable")[:h]]
            if best is None or det < best[0]:
                best = det, m, c
        m, c = shrunk(y[far(y, *best[1:]) <= 11.14], 1.0)
        d = far(y, m, c)
        for i, v in zip(at, d.tolist(), strict=True):
            assert out[i]["distance"] == pytest.approx(v, rel=0.15, abs=0.3)
            if abs(v / 23.51 - 1) > 0.15:
                assert out[i]["kept"] == (v <= 23.51)
    rejected = {r["doc_id"] for r in out if not r["kept"]}
    assert planted <= rejected and len(rejected - planted) <= 3


def test_jaccard(spark, words):
    rng = np.random.default_rng(3)
    base = [f"v{k}" for k in rng.integers(0, 3000, 400)]
    rows, n = [], 0
    for group, (size, edits) in enumerate([(60, 3), (8, 6), (3, 1), (30, 2)]):
        own = base[group * 90 : group * 90 + 80] if group else base[:120]
        for _ in range(size):
            w = list(own)
            for k in rng.integers(0, len(w), rng.integers(0, edits + 1)):
                w[k] = f"u{rng.integers(1 << 30)}"
            rows.append((n, " ".join(w)))
            n += 1
    passage = " ".join(f"p{k}" for k in range(40))
    for _ in range(80):  # share a passage, but aren't alike
        rows.append((n, passage + " " + " ".join(f"z{k}" for k in rng.integers(0, 1 << 30, 100))))
        n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.join(df, limit=6, block=16).collect()}
    sets = defaultdict(list)
    for i, t in rows:
        sets[frozenset(grams(words(t), 5))].append(i)
    keys = list(sets)
    links, parent = Counter(), list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if len(keys[a] & keys[b]) >= 0.8 * len(keys[a] | keys[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, key in enumerate(keys):
        least[root(k)] = min(least.get(root(k), 1 << 60), *sets[key])
    want = {i: (least[root(k)], links[k], len(sets[key])) for k, key in enumerate(keys) for i in sets[key]}
    found, true = sum(v[1] for v in got.values()), sum(v[1] for v in want.values())
    assert found <= true and found >= 0.995 * true
    assert [got[i][0] for i in sorted(got)] == [want[i][0] for i in sorted(want)]
    assert all(got[i][2] == want[i][2] for i in got)


def test_jaccard_of_sets_split_often(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(1500):  # pairs of which one contains the other, and whose words many others have
        w = [f"w{x}" for x in rng.choice(600, 100, replace=False)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:80]))]
    got = {r.doc_id: r.class_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), size=1, limit=2, middle=2).collect()}
    assert all(got[2 * k] == 2 * k for k in range(1500))
    assert sum(got[2 * k + 1] != 2 * k for k in range(1500)) <= 2
    assert jaccard.runs_within(0.999, 2) <= jaccard.runs_for(0.999, 0.8) < jaccard.runs_within(0.999, 7)


def test_decontamination(spark, sf_dir, texts, words):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    punct = str.maketrans("", "", "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in " \t\n\x0b\f\r"))
    norm = lambda t: words((t or "").lower().translate(punct))
    bags = {i: Counter(grams(norm(t), 5)) for i, t in items}
    df = Counter(g for c in bags.values() for g in c)
    weight = lambda g: math.log1p(len(items) / df.get(g, 1))
    want = set()
    for d, t in texts.items():
        g = grams(norm(t), 5)
        for i, c in bags.items():
            if not c.keys() & set(g):
                continue
            k = sum(c.values())
            for a in range(len(g) - k + 1):
                b = Counter(g[a : a + k])
                both = sum(min(n, c[x]) * weight(x) for x, n in b.items() if x in c)
                if both >= 0.8 * (sum(n * weight(x) for x, n in (*b.items(), *c.items())) - both):
                    want.add((d, i))
                    break
    got = {(r.doc_id, r.item_id) for r in decontam.op1_benchmark_decontamination(spark, sf_dir).collect()}
    assert got == want and want


def test_decontamination_of_short_documents(spark, sf_dir, words):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    by = {r.item_id: r.text for r in items.collect()}
    punct = str.maketrans("", "", "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in " \t\n\x0b\f\r"))
    norm = lambda t: words(t.lower().translate(punct))
    bags = {i: Counter(grams(norm(t), 5)) for i, t in by.items()}
    df = Counter(g for c in bags.values() for g in c)
    rows, want = [], set()
    for n, (i, t) in enumerate(sorted(by.items())):
        w = norm(t)
        for off in (1, 2, 3, 6, 12, len(w) - 4):
            for part in (w[:-off], w[off:]):
                rows.append((len(rows), " ".join(part)))
                g = grams(part, 5)
                for j, c in bags.items():
                    k = sum(c.values())
                    for a in range(max(1, len(g) - k + 1) if g else 0):
                        b = Counter(g[a : a + k])
                        weigh = lambda m: sum(v * math.log1p(len(by) / df.get(x, 1)) for x, v in m.items())
                        if weigh(b & c) >= 0.8 * weigh(b | c):
                            want.add((len(rows) - 1, j))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, x.item_id): x.n_words for r in decontam.find_leaks(docs, items).collect() for x in r.leaks}
    assert got.keys() == want and len(want) > 2 * len(by)
    size = {d: len(t.split()) for d, t in rows}
    assert all(n == min(size[d], len(norm(by[i]))) for (d, i), n in got.items())


def test_decontamination_in_blocks_of_items(spark):
    common = [f"c{k}" for k in range(9)]  # 5 shingles, that every other item has
    items = [(i, " ".join([*(common if i % 2 else []), *(f"x{i}y{k}" for k in range(24))])) for i in range(60)]
    rows = [(100 * i + k, " ".join([*w[:9], *(w[9:-k] if k else w[9:])])) for i, t in items for w in [t.split()] for k in range(9)]
    rows += [(100_000 + 100 * i + k, " ".join([*(f"z{j}" for j in range(k)), *w[k:], *(f"v{j}" for j in range(40))])) for i, t in items for w in [t.split()] for k in range(9)]
    rows += [(200_000 + i, " ".join(common[:k] + items[i][1].split()[k:])) for i in range(0, 60, 2) for k in [9]]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    found = lambda **k: {(r.doc_id, *x) for r in decontam.find_leaks(odd, items, **k).collect() for x in r.leaks}
    one = found()
    assert one and found(index_bytes=30_000) == one and found(index_bytes=9_000) == one


def test_short_items_and_the_size_of_the_index(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, "alpha, BETA!"), (4, "x y z w"), (5, "??"), (6, "a b c d e")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so alpha beta it is, alpha beta"), (2, "beta alpha"), (3, "Gamma. x y z w"), (4, "alpha"), (5, "beta"), (6, "a b c d e f")], "doc_id long, text string")
    got = {r.doc_id: [(x.item_id, x.start_word, x.n_words, x.similarity) for x in r.leaks] for r in decontam.find_leaks(docs, items).collect()}
    assert got == {1: [(1, 1, 2, 1.0), (3, 1, 2, 1.0)], 2: [], 3: [(2, 0, 1, 1.0), (4, 1, 4, 1.0)], 4: [], 5: [], 6: [(6, 0, 5, 1.0)]}
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, 40)) for _ in range(5000)]
    index = decontam.Index(list(range(5000)), texts, 5, 16, 4, 0.8)
    arrays = [v for v in vars(index).values() if isinstance(v, np.ndarray)] + [a for t in index.tables for a in t]
    assert sum(a.nbytes for a in arrays) < 40 * 40 * 5000 + 100 * 5000 + (2 << 20)
    prints = np.concatenate([index.prints[:40] ^ np.uint64(0b1011 << 30), rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    want = sorted((x, i) for x, p in enumerate(prints) for i in np.flatnonzero(np.bitwise_count(index.prints ^ p) <= 16).tolist())
    assert index.candidates(prints) == want and len(want) >= 40


def test_hamming_blocks_meet_all_within_the_radius():
    rng = np.random.default_rng(0)
    index = decontam.Index(list(range(20)), [" ".join(f"w{k}" for k in rng.integers(0, 500, 30)) for _ in range(20)], 5, 10, 4, 0.8)
    prints = np.concatenate([index.prints, index.prints ^ np.uint64(0b1011), rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    want = sorted((x, i) for x, p in enumerate(prints) for i in index.items if bin(int(p) ^ int(index.prints[i])).count("1") <= 10)
    assert index.candidates(prints) == want


def test_scores(spark, sf_dir, texts, words):
    whole, own = [Counter() for _ in range(3)], {}
    for i, t in texts.items():
        w = words(t)
        own[i] = [Counter(grams(w, k)) for k in (1, 2, 3)]
        for a, b in zip(whole, own[i], strict=True):
            a.update(b)
    n = sum(whole[0].values())
    for r in lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), chunk_bytes=60_000).collect():
        w, total = words(texts[r.doc_id]), 0.0
        count = lambda g: whole[len(g) - 1][g] - own[r.doc_id][len(g) - 1][g]  # noqa: B023, E731
        for i in range(len(w)):
            up = 0
            for k in (3, 2, 1):
                if i >= k - 1:
                    g = tuple(w[i - k + 1 : i + 1])
                    if count(g):
                        total += math.log(count(g) / (count(g[:-1]) if k > 1 else n - len(w))) + up * math.log(0.4)
                        break
                    up += 1
            else:
                total += up * math.log(0.4) - math.log(n - len(w) + 1)
        assert r.log_score == pytest.approx(total, abs=1e-6) and r.n_full + r.n_backed_off + r.n_unseen == len(w)


def test_scores_with_a_row_for_every_ngram(docs):
    get = lambda out: {r.doc_id: (r.n_words, round(r.log_score, 6), r.n_full, r.n_backed_off, r.n_unseen) for r in out.collect()}
    assert get(lm.score_rows(docs)) == get(lm.score(docs))


def test_licenses(spark, sf_dir, texts):
    got = Counter((r.doc_id, r.license) for r in licenses.op3_license_scan(spark, sf_dir).collect())
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = Counter((i, lines[x]) for i, t in texts.items() for x in (t or "").split("\n") if x in lines)
    assert got == want


def test_licence_wording():
    t = licenses.Templates(licenses.STATEMENTS, 3)
    assert t.scan("licensed under the  APACHE license version 2.0", 0.8)[0] == "Apache-2.0"
    assert t.scan("Licensed under the Apache License, Version 3.0.", 0.8) is None
    assert t.scan("He lost his driving license in version 2.0 of the story.", 0.8) is None


def test_licence_in_a_long_line(texts):
    t = licenses.Templates(licenses.STATEMENTS, 3)
    plain = " ".join(" ".join(x.split()) for _, x in sorted(texts.items()) if x)
    for size in (1_000, 8_000, 100_000):
        for notice in ("Released under the MIT License.", licenses.STATEMENTS[1][1]):
            block = plain[: size // 2] + " " + notice + " " + plain[size // 2 : size]
            assert t.scan(block, 0.8)[0] == ("MIT" if "MIT" in notice else "Apache-2.0")


def test_wrapped_licences(spark):
    import textwrap

    rows, want = [], Counter()
    for k, (name, statement, _) in enumerate(licenses.STATEMENTS):
        if len(statement) > 400:
            continue
        for width in range(40, 81):
            rows.append((100 * k + width, "some code\n\n# " + "\n# ".join(textwrap.wrap(statement, width)) + "\n\nx = 1"))
            want[100 * k + width, name, 2] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.license, r.block) for r in licenses.scan(df).collect()) == want


def test_full_licence_texts(spark):
    import textwrap

    t = licenses.Templates(licenses.STATEMENTS)
    full = {(n, s) for n, s, _ in licenses.STATEMENTS if len(s) > 400}
    assert {n for n, _ in full} == {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib"}
    rng = np.random.default_rng(2)
    for name, text in sorted(full):
        fixed = {w for n, s, f in licenses.STATEMENTS if s == text for w in f.split()}
        for edits in (0, 3, 12):
            w = text.split()
            for k in rng.integers(0, len(w), edits).tolist():  # words replaced, left out and added
                if not fixed & set(licenses.wording(w[k])):
                    w[k] = ["other", "", w[k] + " really"][k % 3]
            found = t.find(licenses.wording("x " * 50 + "\n * ".join(textwrap.wrap(" ".join(w), 70)) + " y" * 300), 0.8)
            assert [f[1] for f in found] == [name]
            assert edits or (found[0][4] == 1.0 and not found[0][5] and not found[0][6])


def test_all_licences_of_a_text(spark):
    one = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    short = [(n, s) for n, s, _ in licenses.STATEMENTS if len(s) < 400]
    every = " Then. ".join(s for _, s in short)
    df = spark.createDataFrame([(1, one), (2, every), (3, every.replace(" ", "\n"))], "doc_id long, text string")
    got = defaultdict(list)
    for r in licenses.scan(df).orderBy("doc_id").collect():
        got[r.doc_id].append(r.license)
    names = [n for n, _ in short]
    assert got == {1: ["MIT", "Apache-2.0"], 2: names, 3: names}


def test_html_form():
    page = "<html><head><title>x</title></head><body><header>Site</header><div class='cookie-notice'>Accept</div><main><header><h1>T &amp; U</h1></header><ul class=menu><li>a</ul><p>one<p>two <i>it</i><script>if (a<b) x('<p>')</script><table><tr><td>c1<td>c2</table><div id='comments'><p>rant</div></main><footer>f</footer>"
    assert html.Page(page).text(None) == "T & U\n\none\n\ntwo it\n\nc1\n\nc2"


def test_html_pages(spark, sf_dir):
    import html as h
    import re

    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html.op9_html_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (r.text, r.n_chars) == (want, len(want))


def test_pipeline_result_is_that_of_plain_stages(spark, sf_dir, words):
    """Every stage's rows against plain sets and loops over what its predecessor kept; the first one's verdicts are the operator's, which has its own test."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r.doc_id for r in quality.op5_quality_rules(spark, sf_dir).collect() if r.kept}
    sets = {i: set(grams(words(docs[i].text), 5)) or {tuple(words(docs[i].text))} for i in kept}
    group = {i: i for i in kept}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    order = sorted(kept)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    kept = {i for i in kept if root(i) == i}
    seen, left = set(), {}
    for i in sorted(kept):
        w = words(docs[i].text)
        gone = [False] * len(w)
        for k, g in enumerate(grams(w, 20)):
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        if not all(gone):
            left[i] = " ".join(x for x, y in zip(w, gone, strict=True) if not y) if any(gone) else docs[i].text
    table = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    leaks = {r.doc_id for r in decontam.find_leaks(table, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r.leaks}
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in left.items() if i not in leaks}
    got = defaultdict(list)
    for r in pipeline.run(spark, sf_dir).orderBy("doc_id", "start").collect():
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == want and leaks and len(left) < len(kept) + 1


def test_pipeline_drops_what_it_should(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs.count()]
    for _, stage in pipeline.STAGES[:4]:
        docs = pipeline._store.materialize(stage(spark, docs, sf_dir), "test-stage")
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[1] < kept[0]
    assert decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("size(leaks) > 0").count() == 0
    again = jaccard.join(docs)
    assert again.filter("doc_id <> class_id").count() == 0
