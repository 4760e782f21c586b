"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulseframe.llm import decontam, html, jaccard, licenses, lm, packing, quality, sharding, substring, tokencount

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven one two three"), (2, None), (3, ""), (4, "tie tie"), (5, "one two three four five six seven one two three")], "item_id long, text string")


def test_decontamination(odd, items, counted):
    out = decontam.find_leaks(odd, items)
    assert ids(out) == counted and out.columns == [*(c for c in odd.columns if c != "leaks"), "leaks"]
    found = {r.doc_id: [x.item_id for x in r.leaks] for r in out.collect()}
    assert found[1] == [1, 5] and found[8] == found[9] == [4] and not any(v for k, v in found.items() if k not in (1, 8, 9))
    assert ids(decontam.find_leaks(odd, items.limit(0))) == counted
    assert decontam.find_leaks(odd.limit(0), items).count() == 0


def test_token_counts(odd, counted):
    out = tokencount.count_tokens(odd)
    assert ids(out) == counted
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in out.collect()}
    assert got[2] == got[3] == (0, 0) and got[6] == got[7] and got[11][0] == 70_000
    assert tokencount.count_tokens(odd.limit(0)).count() == 0


def test_licenses(odd, spark):
    assert licenses.scan(odd).count() == 0
    more = odd.select("doc_id", F.concat_ws("\n", "text", F.lit("Released under the MIT License."), F.lit("licensed under the Apache License, Version 3.0.")).alias("text"), "size")
    assert Counter(r.license for r in licenses.scan(more).collect()) == {"MIT": len(odd.collect())}
    assert licenses.scan(odd.limit(0)).count() == 0


def test_substring(odd, counted):
    out = substring.remove_repeats(odd)
    assert ids(out) == counted
    got = {r.doc_id: (r.n_words, r.n_removed) for r in out.collect()}
    assert got[2] == got[3] == got[4] == (0, 0)
    assert got[7] == (30_000, 30_000) and got[6] == (30_000, 0)
    assert got[8] == (60, 59)  # all windows repeat the first, whose first word no other covers; rows of one id are equals
    assert got[9] == (60, 60)
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def test_quality(odd, counted):
    out = quality.judge(odd)
    assert ids(out) == counted
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].base_failed and got[2].n_words == 0 and not got[2].kept
    assert got[8].base_failed and got[8].n_repeat_words == 60
    assert quality.judge(odd.limit(0)).count() == 0


def test_scores(odd, counted):
    out = lm.score(odd)
    assert ids(out) == counted
    got = {r.doc_id: r for r in out.collect()}
    assert (got[2].n_words, got[2].log_score) == (0, 0.0) and got[6].n_full == 30_000
    assert lm.score(odd.limit(0)).count() == 0


def test_packing(odd, counted):
    out = packing.pack(odd).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in out} == set(counted)
    got = {r.doc_id: (r.n, r.t) for r in out}
    assert got[2] == got[3] == (1, 1) and got[6][0] == got[6][1] and got[8][0] == 2 * got[8][1]
    assert packing.pack(odd.limit(0)).count() == 0
    blank = odd.sparkSession.createDataFrame([(1, "\u00a0"), (2, "\u0085\u00a0")], "doc_id long, text string")
    assert sorted((r.doc_id, r.length) for r in packing.pack(blank).collect()) == [(1, 1), (2, 1)]


def test_jaccard(odd, counted):
    out = jaccard.join(odd)
    assert ids(out) == counted
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in out.collect()}
    assert got[2] == (2, 0, 1) and got[3] == (3, 0, 1)
    assert got[6][0] == got[7][0] == 6 and got[6][2] == 2
    assert got[8] == got[9] == (8, 0, 3)
    assert jaccard.join(odd.limit(0)).count() == 0


def test_html(spark):
    rows = [(1, "http://h.example/a", "<p>one<p>two &amp; three"), (1, "http://h.example/a", "<p>one<p>two &amp; three"), (2, None, "<article>x</article>"), (3, "http://h.example/b", None), (4, "not a url", ""), (5, "http://h.example/c", "<div>" * 3000 + "deep" + "</div>" * 3000), (None, "http://h.example/d", "<p " * 500 + "<b>x")]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = Counter((r.page_id, r.text) for r in html.extract(pages).collect())
    assert got[1, "one\n\ntwo & three"] == 2 and got[2, "x"] == 1 and got[3, ""] == got[4, ""] == 1 and got[5, "deep"] == 1 and sum(got.values()) == 7
    assert html.extract(pages.limit(0)).count() == 0


def test_deep_and_unclosed_html():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    page = html.Page("<div>" * 100_000 + "deep" + "</div>" * 100_000)
    assert page.text(None) == page.text(page.best().key) == "deep" and page.best().path() == ">".join(["div"] * 100_000)
    assert html.Page("<b><article>" + "<span>" * 50_000 + "x" + "</b>" * 50_000).text(None) == "x"
    assert html.Page("<li><ul>" + "<span>" * 30_000 + "<li>y" * 30_000).text(None).count("y") == 30_000
    assert html.Page("<body><p>" + "<i>" * 100 + "one<div>two").text(None) == "one\n\ntwo"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB


def test_sharding(odd, counted):
    out = sharding.shard(odd, 4)
    assert ids(out) == counted and set(odd.columns) <= set(out.columns)
    rows = out.collect()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.doc_id: r["size"] for r in rows}[2] == 1
    assert sharding.shard(odd.limit(0), 4).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(k, spark, odd, sf_dir):
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    out = stage(spark, docs, sf_dir)
    if k < 4:
        assert out.columns == docs.columns
    kept = ids(out)
    if name == "near duplicates":
        assert kept[6] == 1 and kept[7] == 0 and kept[8] == 1 and kept[9] == 0 and kept[None] == 1 and kept[2] == kept[3] == 1
    if name == "substring dedup":
        assert kept[6] == 1 and kept[7] == 0
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_blocks_of_items_are_one_worker(spark):
    """However many blocks: one Python node, no exchange of documents, ids as they are, nothing known twice."""
    texts = [" ".join(f"w{(k * 7 + i * i) % 450}" for i in range(30)) for k in range(60)]
    items = spark.createDataFrame([(None, texts[0]), (-1, texts[1])] + [(k, t) for k, t in enumerate(texts) if k > 1], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t.upper()} after, and more", k, "x") for k, t in enumerate(texts)] + [(90, None, 0, None), (91, "", 0, "")], "doc_id long, text string, item_id int, __lower string")
    found = {}
    for size in (64 << 20, 9_000, 30_000):
        out = decontam.find_leaks(docs, items, index_bytes=size)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and out.columns == ["doc_id", "text", "item_id", "__lower", "leaks"]
        rows = out.collect()
        assert {r["__lower"] for r in rows} == {"x", None, ""}
        found[size] = sorted(((r.doc_id, *x) for r in rows for x in r.leaks), key=str)
    assert found[9_000] == found[30_000] == found[64 << 20]
    assert {(0, None), (1, -1), (5, 5)} <= {x[:2] for x in found[9_000]} and (0, -1) not in {x[:2] for x in found[9_000]}
