"""Main text of hand-made pages, and hosts' votes against a loop over pages."""

from collections import Counter, defaultdict

import pytest

from pulseframe.llm import html

A = "<h1>Title</h1><p>One two three four five six seven eight nine ten.</p><p>More of it, with a <a href=x>link</a>.</p>"
TEXT = "Title\n\nOne two three four five six seven eight nine ten.\n\nMore of it, with a link."
NAV = "<nav><a href=/>Home</a> <a href=/b>About us and others</a></nav>"
FOOT = "<footer>All rights reserved by somebody somewhere</footer>"
LONG = "".join(f"<p>Reader {i} says a lot about this, at length, and on and on and on.</p>" for i in range(9))

PAGES = {
    "plain": f"{NAV}<article>{A}</article>{FOOT}",
    "layout has-sidebar": f'<div class="layout has-sidebar"><article>{A}</article></div><div>x</div>',
    "utility classes": f'<div class="overflow-hidden p-4"><article>{A}</article></div>',
    "aria-hidden false": f'<article aria-hidden="false">{A}</article><div aria-hidden="true">not seen</div>',
    "aria-hidden inside": f'<article>{A}<span aria-hidden="true">*</span><p aria-hidden=true>not seen</p></article>',
    "post no-comments": f'<div class="post no-comments">{A}</div>{FOOT}',
    "article no-comments": f'<article class="post no-comments comments-open">{A}</article>',
    "related work": f'<article>{A}<section id="related-work"><p>Others did this before.</p></section></article>',
    "market share": f'<article>{A}<section class="market-share"><p>Half of it.</p></section></article>',
    "title with a hidden gem": f'<article>{A}<p title="a hidden gem">A gem.</p></article>',
    "hidden attribute": f'<article>{A}<p hidden>gone</p><div hidden=""><p>gone too</p></div></article>',
    "style": f'<article>{A}<div style="color:red; display : none">gone</div><div style="display:block">Seen.</div></article>',
    "page in a form": f'<form action="/x"><input type=hidden name=v>{NAV}<div>{A}</div><select><option>one</select>{FOOT}</form>',
    "article in a form": f"<body><form>{NAV}<article>{A}</article></form></body>",
    "form inside": f"<article>{A}<form><label>Your mail</label><input><button>Send</button></form></article>",
    "no article": f"<body>{NAV}<div class=content>{A}</div><div class=sidebar><ul><li><a href=1>other</a></ul></div>{FOOT}</body>",
    "only in an aside": f"<body>{NAV}<aside>{A}</aside>{FOOT}</body>",
    "wrapper called sidebar": f'<div class="sidebar"><main>{A}</main></div>',
    "wrapper called menu, with paragraphs": f'<body><div id="menu">{A}</div><div>{FOOT}</div></body>',
    "comments beside": f'<article>{A}</article><div id="comments">{LONG}</div>',
    "comments inside": f'<article>{A}<section class="comment-list">{LONG}</section></article>',
    "comments as articles": f'<main>{A}<ol class="comments"><li><article>{LONG}</article></ol></main>',
    "comment articles alone": f'<main>{A}<article class="comment">{LONG}</article></main>',
    "comments longer than a page without article": f'<body><div class=content>{A}</div><div class="comments-area">{LONG}</div></body>',
    "cookie notice and adverts": f'<div class="cookie-notice"><p>We use cookies.</p></div><div class=ad>Buy</div><article>{A}<div class="ad-slot">Buy more</div><div class="share-buttons">Tell all</div></article>',
    "related posts": f'<article>{A}<div class="related-posts"><p>Other things</p></div></article>',
    "roles": f'<div role=banner>Site</div><div role="main">{A}</div><div role=complementary>Aside</div><div role="contentinfo">(c)</div>',
    "header of the page and of the article": f"<header>Site name</header><article><header><h2>Sub</h2></header>{A}</article>",
    "hidden until a script shows it": f'<body><div style="display:none"><article>{A}</article></div><noscript>Turn scripts on</noscript></body>',
}
EXTRA = {
    "related work": "\n\nOthers did this before.",
    "market share": "\n\nHalf of it.",
    "title with a hidden gem": "\n\nA gem.",
    "style": "\n\nSeen.",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    want = TEXT + EXTRA.get(name, "")
    if name.startswith("header of"):
        want = "Sub\n\n" + want
    assert html.Page(f"<!DOCTYPE html><html><head><title>t</title></head>{PAGES[name]}</html>").text(None) == want


def test_pages_in_spark(spark):
    rows = [(i, f"https://h{i}.org/", p) for i, p in enumerate(PAGES.values())]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: html.Page(p).text(None) for i, _, p in rows}


@pytest.mark.parametrize("token,kind", [("ad", 1), ("top-ad", 1), ("read", 0), ("has-sidebar", 0), ("sidebar_left", 0), ("left_sidebar", 1), ("comment", 2), ("comment-body", 2), ("no-comments", 0), ("market-share", 0), ("share", 1), ("share-bar", 1), ("related-work", 0), ("related-posts", 1), ("navbar", 1), ("content", 0), ("", 0), ("42", 0), ("search", 1), ("research", 0), ("without-ads", 0), ("ads2", 1)])
def test_marks(token, kind):
    assert html.marked(token) == kind


def test_host_votes(spark):
    """Votes by host: the share of each page's text in its best container, added up; ties and hosts without a url included."""
    shape = {"a": "<body><div class='c{n}'>{t}</div><div>x</div></body>", "b": "<body><section>{t}</section></body>"}
    rows = []
    for i in range(60):
        host = ["https://A.org/x", "http://b.org?y", "https://c.org#z", None][i % 4]
        kind = "ab"[(i * i + i // 4) % 2] if i % 4 else "aab"[i % 3]
        rows.append((i, host, shape[kind].format(n=i, t="<p>" + "word " * (5 + i % 7) + "</p>") if i != 13 else None))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    votes, pages = defaultdict(float), Counter()
    for _, url, source in rows:
        best = (page := html.Page(source)).best() if source else None
        if best:
            host = "\x00" if url is None else url.split("://")[1].lower()[:5]
            votes[host, best.path()] += round(best.text / max(1, page.containers[0].text), 6)
            pages[host, best.path()] += 1
    got = {r.host: r for r in html.host_paths(df).collect()}
    assert set(got) == {h for h, _ in votes}
    for host, r in got.items():
        own = {p: (round(v, 3), pages[h, p]) for (h, p), v in votes.items() if h == host}
        assert own[r.path] == max(own.values()) == (round(r.votes, 3), r.pages)
    # a page without its host's path uses its own container, one with it takes that
    text = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(text[i].startswith("word word") for i, _, s in rows if s) and text[13] == ""
