"""Main-text extraction from web pages by consensus host paths (operator 9).

1. Every page is parsed; each container (``body``, ``main``, ``article``,
   ``section``, ``div``, ``td``) is scored by its text outside menus, forms,
   adverts and the like, less the boilerplate text inside it.  The page's vote
   goes to the generalised path (tags and classes, digits dropped) of its best
   container, weighted by that container's share of the page's text.
2. Spark adds up votes by host and path, after each task has added up its own,
   so a host with a third of all pages costs a row per task and path.
3. Every page is parsed again and its text taken from the containers on its
   host's winning path; a page without that path uses its own best container.

A host's winner is one row: its name and 64 bits that stand for the path.  They
are broadcast while they are at most ``broadcast_bytes``, and joined by shuffle
beyond it.  An element links to its parent, and what an end tag closes is looked
up, so memory and time grow with the page, however deep its elements nest.

Text: character references decoded, white space in a block one space, blocks
in page order joined by two line feeds.  Defined cases: null or blank html
gives an empty text; a null url is a host of its own; rows aren't merged; of
paths with equal votes and pages the greater key wins; an empty table gives an
empty one; further columns pass through (``text`` and ``n_chars`` replace theirs).
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import _store, _words

#: Fixed values of HTML: elements without an end tag; whose content is not markup; that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("body main article section div td".split())
#: Whose class and id say nothing about their place in the page.
PROSE = frozenset("body html h1 h2 h3 p b i em strong".split())
#: Elements that hold no article, whatever is in them; and those that mark what isn't the article, unless it turns out to be in them.
NEVER = frozenset("head button select input svg canvas object audio video map".split()) | RAW
ASIDE = frozenset("nav footer aside form dialog menu label fieldset".split())
#: Words that mark the same as a whole token of class, id or role, or as the last part of one (``cookie-notice``); a word of ``NOT`` before it says otherwise (``has-sidebar``).
MARKS = frozenset(
    "ad ads adbox advert advertisement advertisements adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion respond shoutbox sidebar signup sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words that do so only as a whole token (``share``, not ``market-share``), and before a word for a part of a page (``related-posts``, not ``related-work``), as do ``MARKS``.
WHOLE = frozenset("complementary dialog login promotion recommended related replies reply search share sharing skip social".split())
FRAME = frozenset("area articles bar block body box btn button buttons container form group icons inner item items label link links list overlay panel posts row section slot stories text thread title unit wrap wrapper".split())
NOT = frozenset("has have is no non not with without".split())
COMMENT = frozenset("comment comments commentlist disqus replies reply respond shoutbox".split())
#: What an open element is closed by, where its end tag may be left out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>|</?[a-zA-Z][^>]*>?", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
PIECES = re.compile(r"[^a-zA-Z]+")


#: Inside these an end tag closes nothing further out, unless it ends a block.
SCOPE = ("td", "table", "article", "main")
LISTS = ("ul", "ol", "dl", "table", "select", "menu", "dir")
_codes: dict[str, int] = {}


def code(label: str) -> int:
    """64 bits that stand for a label, the same in every process."""
    found = _codes.get(label)
    if found is None:
        if len(_codes) > 50_000:
            _codes.clear()
        found = _codes[label] = int.from_bytes(hashlib.blake2b(label.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    return found


def marked(token: str) -> int:
    """1 if a token of class, id or role marks boilerplate, 2 if reader comments, else 0."""
    words = [w for w in PIECES.split(token) if w]
    if not words or NOT & set(words[:-1]):
        return 0
    last, first = words[-1], words[0]
    if last in MARKS or token in WHOLE:
        return 2 if last in COMMENT else 1
    if len(words) > 1 and last in FRAME and (first in MARKS or first in WHOLE):
        return 2 if first in COMMENT else 1
    return 0


#: How an element is judged when it opens: to be kept, left out unless the article is in it, reader comments, or left out for good.
KEPT, DOUBTFUL, COMMENTS, OUT = range(4)


class Node:
    """An element; ``key`` stands for its path, which is only written out when asked for. ``prose`` is text in paragraphs."""

    __slots__ = ("tag", "label", "parent", "key", "kind", "skip", "text", "noise", "prose", "first", "last")

    def __init__(self, tag: str, label: str, parent: "Node | None", kind: int, first: int):
        self.tag, self.label, self.parent, self.kind, self.first, self.last = tag, label, parent, kind, first, -1
        self.key = ((parent.key * 0x9E3779B97F4A7C15 if parent else 0) + code(label)) & 0xFFFFFFFFFFFFFFFF
        self.text = self.noise = self.prose = 0
        self.skip = False

    def path(self) -> str:
        out, node = [], self
        while node:
            out.append(node.label)
            node = node.parent
        return ">".join(reversed(out))


class Page:
    """Blocks of a page's text, and its containers.

    What marks boilerplate is noted while the page is read and decided at its
    end: an element that holds the article isn't left out, whatever it is called.
    If all ``article`` and ``main`` elements with text stand in doubtful elements,
    those around them are kept; if there are none, doubtful elements with over half of
    the page's paragraph text (all text, if it has no paragraphs) are. Reader
    comments don't count for this and stay out.

    ``where`` holds, for each tag, the places of its open elements in the stack,
    so that what an end tag closes is found without a walk.
    """

    def __init__(self, source: str):
        self.raw: list[list[tuple[Node | None, str]]] = []  # finished blocks, as runs of text and where they stand
        self.at: list[tuple[Node | None, str]] = []  # the open block's runs
        self.nodes: list[Node] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.inner: list[int] = []  # places of open blocks
        stack: list[Node] = []
        pos, n = 0, len(source)
        find = TOKEN.search
        while pos < n:
            m = find(source, pos)
            end = m.start() if m else n
            if end > pos:
                self._run(source[pos:end], stack)
            if not m:
                break
            pos = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag, stack)
                continue
            if tag == "br":
                self.at.append((stack[-1] if stack else None, " "))
                continue
            self._start(tag, m[3] or "", stack)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, pos)
                if stack and stack[-1].tag == tag:
                    stack.pop()
                    self.where[tag].pop()
                pos = close.end() if close else n
        self._close(stack, 0)
        self._flush()
        self._decide()
        self.blocks = [" ".join("".join(t for node, t in runs if node is None or not node.skip).split()) for runs in self.raw]
        self.containers = [c for c in self.nodes if c.tag in CONTAINER and not c.skip]
        del self.raw, self.nodes

    def _flush(self) -> None:
        if self.at:
            self.raw.append(self.at)
            self.at = []

    def _run(self, raw: str, stack: list[Node]) -> None:
        text = _html.unescape(raw) if "&" in raw else raw
        node = stack[-1] if stack else None
        self.at.append((node, text))
        if node is not None:
            size = len(text.strip())
            node.text += size
            if self.where.get("p"):
                node.prose += size

    def _decide(self) -> None:
        """What is left out, and from that the text and the noise of every element; parents come before their children."""
        total: dict[Node, int] = {}
        prose, plain = 0, 0
        for node in reversed(self.nodes):
            own = total[node] = total.get(node, 0) + node.text
            if node.parent is not None:
                if node.kind < COMMENTS:
                    node.parent.prose += node.prose
                    total[node.parent] = total.get(node.parent, 0) + own
            else:
                prose, plain = prose + node.prose, plain + own
        gone: set[Node] = set()  # in comments, or out for good
        for node in self.nodes:
            node.skip = node.kind > KEPT or node.parent is not None and node.parent.skip
            if node.kind > DOUBTFUL or node.parent in gone:
                gone.add(node)
        mains = [c for c in self.nodes if c.tag in ("article", "main") and c.kind == KEPT and total[c] and c not in gone]
        if any(c.skip for c in self.nodes if c.kind == DOUBTFUL) and not any(not c.skip for c in mains):
            if mains:
                held = set()
                for c in mains:
                    while c is not None and c not in held:
                        held.add(c)
                        c = c.parent
            else:
                held = {c for c in self.nodes if (2 * c.prose > prose if prose else 2 * total[c] > plain)}
            for node in self.nodes:
                node.skip = node.kind > DOUBTFUL or node.kind == DOUBTFUL and node not in held or node.parent is not None and node.parent.skip
        for node in reversed(self.nodes):
            if node.skip:
                node.noise, node.text = node.noise + node.text, 0
            if node.parent is not None:
                node.parent.text += node.text if not node.parent.skip else 0
                node.parent.noise += node.noise + (node.text if node.tag == "a" else 0)

    def _close(self, stack: list[Node], upto: int) -> None:
        """End all elements from place ``upto`` on."""
        while len(stack) > upto:
            node = stack.pop()
            self.where[node.tag].pop()
            if node.tag in BLOCK:
                self.inner.pop()
                self._flush()
            node.last = len(self.raw)

    def _last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def _start(self, tag: str, attrs: str, stack: list[Node]) -> None:
        if tag in BLOCK:
            open_p = self.where.get("p")
            if open_p and self.inner[-1] == open_p[-1]:  # an open paragraph ends here
                self._close(stack, open_p[-1])
            closes = CLOSES.get(tag)
            if closes and (k := self._last(closes)) > self._last(LISTS):
                self._close(stack, k)
            self._flush()
        if tag in VOID:
            return
        parent = stack[-1] if stack else None
        kind = OUT if tag in NEVER else DOUBTFUL if tag in ASIDE else KEPT
        label = tag
        if attrs:
            named = []
            for name, value in ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "class":
                    label += "".join("." + w for w in sorted({re.sub(r"\d+", "", x) for x in value.split()}))
                if name in ("class", "id", "role"):
                    named += value.split()
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and UNSEEN.search(value):
                    kind = max(kind, DOUBTFUL)
            if named and tag not in PROSE and kind < COMMENTS:
                mark = max(map(marked, named))
                if mark == 2 or mark and tag not in ("article", "main"):
                    kind = max(kind, COMMENTS if mark == 2 else DOUBTFUL)
        if tag == "header" and not self.where.get("article") and not self.where.get("main"):
            kind = max(kind, DOUBTFUL)
        node = Node(tag, label, parent, kind, len(self.raw))
        self.nodes.append(node)
        self.where[tag].append(len(stack))
        if tag in BLOCK:
            self.inner.append(len(stack))
        stack.append(node)

    def _end(self, tag: str, stack: list[Node]) -> None:
        places = self.where.get(tag)
        if places:
            if tag in BLOCK or places[-1] == len(stack) - 1 or places[-1] >= self._last(SCOPE):
                self._close(stack, places[-1])
        elif tag in BLOCK:
            self._flush()

    def best(self) -> Node | None:
        """The container of most text less boilerplate; of equal ones the innermost, and named ones first."""
        best, most = None, 0.0
        for c in self.containers:
            score = (c.text - c.noise) * (1.1 if c.tag in ("article", "main") else 1.0)
            if score > 0 and score >= most:
                best, most = c, score
        return best

    def text(self, key: int | None) -> str:
        """Text of the containers with the path of this key, else of the best one."""
        found = [c for c in self.containers if c.key == key] if key is not None else []
        if not found:
            best = self.best()
            if best is None:
                return "\n\n".join(filter(None, self.blocks))
            found = [best]
        out, upto = [], 0
        for c in found:  # in page order; one inside another isn't taken twice
            out += self.blocks[max(c.first, upto) : c.last]
            upto = max(upto, c.last)
        return "\n\n".join(filter(None, out))


def _host(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("\x00"))


def _winners(pages: DataFrame, url_col: str, html_col: str, named: bool) -> DataFrame:
    """host, key, votes, pages and (if ``named``) path of each host's winner."""
    ship(pages.sparkSession)

    def vote(batches):
        for b in _words.slices(batches, "html", 8 << 20):
            votes: dict[tuple[str, int], list] = {}
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                best = (page := Page(source)).best() if source else None
                if best is not None:
                    v = votes.get((host, best.key))
                    if v is None:
                        v = votes[host, best.key] = [0.0, 0, best.path() if named else ""]
                    v[0] += round(best.text / max(1, page.containers[0].text), 6)
                    v[1] += 1
            keys = np.array([k for _, k in votes], np.uint64).view(np.int64)
            score, n, path = (list(x) for x in zip(*votes.values(), strict=True)) if votes else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array(keys), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(path, pa.string())], names=["host", "key", "votes", "pages", "path"])

    votes = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(vote, "host string, key long, votes double, pages long, path string")
    votes = votes.groupBy("host", "key").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"), *([F.min("path").alias("path")] if named else []))
    columns = [c for c in votes.columns if c != "host"]
    won = F.max_by(F.struct(*columns), F.struct(F.round("votes", 3), "pages", "key"))
    return votes.groupBy("host").agg(won.alias("won")).select("host", *(f"won.{c}" for c in columns))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning path of each host, with its votes and pages; ``key`` stands for the path."""
    return _winners(pages, url_col, html_col, True)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars``."""
    winners = _store.materialize(_winners(pages, url_col, html_col, False).select(F.col("host").alias("__host"), F.col("key").alias("__key")), "host-paths")
    size = winners.agg(F.coalesce(F.sum(F.octet_length("__host") + 64), F.lit(0))).first()[0]  # 64: the row around it
    if size <= broadcast_bytes:
        winners = F.broadcast(winners)
    keep = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    joined = pages.select(*keep, F.col(html_col).alias("__html"), _host(url_col).alias("__host")).join(winners, "__host", "left").select(*keep, "__html", "__key")
    schema = joined.select(*keep, F.col("__html").alias("text")).schema

    def run(batches):
        for b in _words.slices(batches, "__html", 8 << 20):
            *rest, source, key = b.columns
            keys = (None if k is None else k & 0xFFFFFFFFFFFFFFFF for k in key.to_pylist())
            texts = [Page(s).text(k) if s else "" for s, k in zip(source.to_pylist(), keys, strict=True)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], names=[*keep, "text"])

    return joined.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = _store.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
