"""Main text of HTML pages by gradient-boosted trees over DOM-node features and a hierarchical decoding.

Every element that stands for a part of the page is a node with features: its tag, words of its class, id and role,
depth, text and link density of its subtree, its share of the page, siblings, and what its ancestors said. The trees
give each node the log-odds of being content. A node may be outside (above the article), content, or removed; along
every path from the root the states can only go outside* content* removed*, and the best such labelling of the whole
page is found by dynamic programming, so an ancestor and a descendant cannot contradict each other.

The model is fitted on a bounded, documented sample: up to `sample_pages` different pages of the table, of any length, by
hash order. Each gives up to RUNS of its text runs, evenly spread over the page and cut to RUN_CHARS characters, to a few
layouts whose content nodes are known; the layouts mix the names that sites use with made-up ones, so that the model also
learns from structure alone. Where the table has fewer pages, filler text goes on in their place.

Defined results: a null or empty html has the text ''; a page without a content node has ''; a page is parsed whole, in
time that grows with its length alone; equal rows are rows of their own; null urls and page_ids are kept; an empty table
gives no rows; extra columns are not read."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import slices

SAMPLE_PAGES, RUNS, RUN_CHARS = 150, 200, 2_000

OPENING = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
#: What follows a tag's name: quotes hide a >.
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
RAW = {x: re.compile(f"</{x}", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening one of these ends an open p.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Opening one of these ends the open one of the same set.
ENDS_OWN = {x: own for own in (("li",), ("dt", "dd"), ("option",), ("td", "th"), ("tr",)) for x in own}
SPACE = " \t\n\r\f\v"
ATTRS = re.compile(r"(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
GOOD = frozenset("article articlebody body content contents entry main post story text".split())
BAD = frozenset("ad ads advert advertisement advertising banner bar breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies discussion dialog disqus footer form gdpr head header login masthead menu meta modal nav navigation navbar newsletter notice overlay pagination pager popup privacy promo promoted promotion recommended related reply replies respond search share sharing sidebar sign signup social sponsor sponsored subscribe subscription tags teaser toolbar topbar tracking widget".split())
TAGS = {x: i for i, own in enumerate((("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "button", "select", "input", "fieldset", "dialog"), ("script", "style", "noscript", "template", "svg", "iframe", "title", "textarea", "head", "object", "canvas"), ("div", "section"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tr", "td", "th", "tbody", "thead"), ("html", "body"))) for x in own}
FEATURES = 14 + 16


@dataclass
class Node:
    tag: str
    attrs: str
    parent: int
    inline: bool
    depth: int
    children: list[int] = field(default_factory=list)
    chars: int = 0
    links: int = 0
    tags: int = 0
    marks: int = 0


class Markup:
    """Finds a page's tags one after the other. Nothing is scanned twice: where no > comes any more there are no tags, and
    from the first tag on whose quotes never close, a table says for every place where a tag would end."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.marks: list[int] | None = None
        self.ends: list[int] = []

    def tabulate(self) -> None:
        """For each of > " ' where a tag ends whose scan comes there outside of quotes (-1: nowhere)."""
        self.marks = [m.start() for m in re.finditer("[>\"']", self.page)]
        self.ends, later = [-1] * (len(self.marks) + 1), {}
        for k in range(len(self.marks) - 1, -1, -1):
            mark = self.page[self.marks[k]]
            if mark == ">":
                self.ends[k] = self.marks[k]
            else:
                self.ends[k] = self.ends[later[mark] + 1] if mark in later else -1
                later[mark] = k

    def end_of(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`: at the first > outside of quotes, else at the first > at all."""
        if self.marks is None:
            if m := QUOTED.match(self.page, at):
                return m.end() - 1
            self.tabulate()
        end = self.ends[bisect_left(self.marks, at)]
        return end if end >= 0 else self.page.find(">", at)

    def tag(self, at: int) -> tuple[int, int, str | None, str, str] | None:
        """(start, end, "/" or "", name, attributes) of the next tag; of a comment or the like the third is None."""
        m = OPENING.search(self.page, at)
        if m and m.start() > self.last and not m[1]:
            start = self.page.find("<!--", m.start())
            return None if start < 0 else (start, len(self.page), None, "", "")
        if not m:
            return None
        if m[1]:
            end = self.page.find("-->", m.end())
            return m.start(), len(self.page) if end < 0 else end + 3, None, "", ""
        if not m[3]:
            return m.start(), self.page.find(">", m.end()) + 1, None, "", ""
        end = self.end_of(m.end())
        return m.start(), end + 1, m[2], m[3].lower(), self.page[m.end() : end]

    def tags(self) -> Iterator[tuple[int, int, str | None, str, str]]:
        found = self.tag(0)
        while found:
            yield found
            found = self.tag(found[1])

    def closing(self, tag: str, at: int) -> tuple[int, int] | None:
        """Where the next end tag of a raw element begins and ends."""
        m = RAW[tag].search(self.page, at) if at <= self.last else None
        return (m.start(), self.page.find(">", m.end()) + 1) if m and m.end() <= self.last else None


def dom(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The page's elements in order, and its text runs in order, each with its element; '' stands for a line break.

    Unclosed and stray tags are mended the way browsers do for the common cases."""
    nodes, runs, stack, at = [Node("#root", "", -1, False, 0)], [], [0], 0
    places: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
    blocks = [0]  # where in the stack elements that are not inline are open
    end, unclosed = len(page), set()

    def close(to: int) -> None:
        while len(stack) > to:
            places[nodes[stack.pop()].tag].pop()
        while blocks[-1] >= to:
            blocks.pop()

    last = lambda *tags: max((p[-1] for t in tags if (p := places.get(t))), default=-1)
    markup = Markup(page)
    while found := markup.tag(at):
        start, until, ending, tag, attrs = found
        if start > at:
            runs.append((stack[-1], page[at:start]))
        at = until
        if ending is None:
            continue
        if ending:
            open_at = last(tag)
            if open_at > 0 and (tag not in INLINE or open_at >= blocks[-1]):
                close(open_at)
            continue
        if tag == "br":
            runs.append((stack[-1], ""))
        if tag in ENDS_P and nodes[stack[blocks[-1]]].tag == "p":
            close(blocks[-1])
        if tag in ENDS_OWN and (own := last(*ENDS_OWN[tag])) > last("ul", "ol", "dl", "table", "select"):
            close(own)
        marked = " ".join(a or b or c for _, a, b, c in ATTRS.findall(attrs)).lower() if "=" in attrs else ""
        parent = stack[-1]
        nodes.append(Node(tag, marked, parent, tag in INLINE and not marked, nodes[parent].depth + 1))
        nodes[parent].children.append(len(nodes) - 1)
        if tag in VOID:  # as in browsers, a slash closes no other element
            continue
        if tag in RAW:
            closing = markup.closing(tag, at) if tag not in unclosed else None
            if closing is None and tag in ("script", "style"):
                at = end
                break
            if closing is not None:
                runs.append((len(nodes) - 1, page[at : closing[0]]))
                at = closing[1]
                continue
            unclosed.add(tag)
        places.setdefault(tag, []).append(len(stack))
        if not nodes[-1].inline:
            blocks.append(len(stack))
        stack.append(len(nodes) - 1)
    if at < end:
        runs.append((stack[-1], page[at:]))
    return nodes, runs


def blocks_of(nodes: list[Node]) -> list[int]:
    """For each element the nearest one at or above it that is not inline."""
    out = [0] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].parent] if nodes[i].inline else i
    return out


def features(nodes: list[Node], runs: list[tuple[int, str]]) -> tuple[list[int], np.ndarray]:
    """The numbers of the elements that are judged, and their features; plain inline elements go with their parents."""
    for i, text in runs:
        n = len(text) - text.count(" ") - text.count("\n")
        nodes[i].chars += n
        nodes[i].marks += text.count(",") + text.count(".")
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        x, up = nodes[i], nodes[nodes[i].parent]
        up.chars += x.chars
        up.marks += x.marks
        up.tags += x.tags + 1
        up.links += x.chars if x.tag == "a" else x.links
    whole = max(nodes[0].chars, 1)
    judged = [i for i in range(1, len(nodes)) if not nodes[i].inline]
    out = np.zeros((len(judged), FEATURES))
    block = blocks_of(nodes)
    said = {0: (0, 0, 0)}  # of an element and what is above: good words, bad words, a tag that is never an article's
    place: dict[int, int] = {}
    for row, i in enumerate(judged):
        x = nodes[i]
        words = set(WORD.findall(x.attrs)) if x.attrs else ()
        good, bad = len(GOOD.intersection(words)), len(BAD.intersection(words))
        above = said[block[x.parent]]
        kind = TAGS.get(x.tag, -1)
        if kind >= 0:
            out[row, kind] = 1
        said[i] = (above[0] + good + (kind == 0), above[1] + bad, above[2] + (1 <= kind <= 6))
        siblings = nodes[x.parent].children
        nth = place[x.parent] = place.get(x.parent, -1) + 1
        out[row, 14:] = (x.depth, np.log1p(x.chars), x.links / max(x.chars, 1), x.chars / (x.tags + 1), x.marks / max(x.chars, 1), x.chars / whole, len(siblings), nth / len(siblings), x.chars / max(nodes[x.parent].chars, 1), good, bad, *above, len(x.children), x.tags)
    return judged, out


def decode(nodes: list[Node], judged: list[int], odds: np.ndarray) -> set[int]:
    """The judged elements that are content in the best labelling along outside* content* removed*."""
    own = dict(zip(judged, odds.tolist(), strict=True))
    best = [[0.0, 0.0, 0.0] for _ in nodes]  # of a subtree, where its top is outside, content, removed
    sums = [[0.0, 0.0, 0.0] for _ in nodes]  # the children's best under each
    for i in range(len(nodes) - 1, -1, -1):
        kept = own.get(i, 0.0)
        o, c, r = sums[i]
        best[i] = [o - kept / 2, c + kept / 2, r - kept / 2]
        if i:
            s = sums[nodes[i].parent]
            if nodes[i].inline:
                s[0], s[1], s[2] = s[0] + o, s[1] + c, s[2] + r
            else:
                s[0], s[1], s[2] = s[0] + max(best[i]), s[1] + max(best[i][1], best[i][2]), s[2] + best[i][2]
    state = [0] * len(nodes)
    for i in range(1, len(nodes)):
        up = state[nodes[i].parent]
        if nodes[i].inline:
            state[i] = up
        elif up == 0:
            state[i] = max((0, 1, 2), key=lambda k: (best[i][k], -k))
        else:
            state[i] = 1 if up == 1 and best[i][1] >= best[i][2] else 2
    return {i for i in range(len(nodes)) if state[i] == 1}


def text_of(nodes: list[Node], runs: list[tuple[int, str]], content: set[int]) -> str:
    """The text of content elements: blocks in page order, white space as one blank."""
    out, before, owner = [], None, blocks_of(nodes)
    for i, text in runs:
        block = owner[i]
        if i in content:
            out.append(" " if block != before or not text else "")
            out.append(entities.unescape(text) if "&" in text else text)
        before = block
    return " ".join(x for x in re.split(f"[{SPACE}]+", "".join(out)) if x)


def extract(pages: list[str], model: gbt.Trees) -> list[str]:
    """The main text of each page; the nodes of all are scored together."""
    doms = [dom(page) for page in pages]
    rows = [features(*x) for x in doms]
    odds = np.split(gbt.score(model, np.concatenate([x for _, x in rows])), np.cumsum([len(j) for j, _ in rows])[:-1]) if rows else []
    return [text_of(nodes, runs, decode(nodes, judged, own)) for (nodes, runs), (judged, _), own in zip(doms, rows, odds, strict=True)]


FILLER = "the of and a to in was it for on as at by from they with his her that were had page more news home about contact terms read week year time people world after first city work back where while many under".split()


def layouts(texts: list[str], seed: int) -> Iterator[tuple[str, list[bool]]]:
    """Pages made of given text runs, with the label of each judged element: content where marked so by the layout."""
    rng = np.random.default_rng(seed)
    pick = lambda n: " ".join((texts[int(rng.integers(len(texts)))] or "x").split()[: int(n)]) or "x"
    one = lambda *x: x[int(rng.integers(len(x)))]
    some = lambda a, b: int(rng.integers(a, b))
    scale = one(1.0, 1.0, 0.2)  # of paragraphs: some sites have short articles
    long = lambda a, b: some(a, max(a + 1, int(b * scale)))
    plain_names = rng.random() < 0.4  # a site whose class names say nothing
    made = lambda: "".join(one("ab", "ku", "row", "c", "x", "tm", "zo", "mod", "blk", "w") for _ in range(some(1, 4))) + one("", "", str(some(1, 60)))
    cls = lambda *names: made() if plain_names and rng.random() < 0.8 else one(*names)
    links = lambda n: "".join(f'<li><a href="/{k}">{pick(some(1, 4))}</a></li>' for k in range(int(n)))
    row = lambda n, gap: gap.join(f'<a href="/{k}">{pick(some(1, 4))}</a>' for k in range(int(n)))
    menu = lambda: one(f"<nav><ul>{links(some(2, 9))}</ul></nav>", f'<div class="{cls("menu", "navbar", "site-nav", "breadcrumb", "topnav")}"><ul>{links(some(2, 9))}</ul></div>', f'<ul id="{cls("menu", "navigation")}">{links(some(2, 9))}</ul>', f'<div class="{cls("nav", "links", "toolbar")}">{row(some(3, 9), one(" | ", " ", " &middot; "))}</div>')
    advert = lambda: f'<div class="{one("ad", "ads", "advert", "banner-ad", "sponsored", "promo")}">{one(pick(some(3, 40)), f"<p>{pick(some(3, 40))}</p>", f"<a href=/x>{pick(4)}</a>")}</div>'
    notice = lambda: f'<{(t := one("div", "section"))} class="{one("cookie-notice", "gdpr-banner", "consent", "notice", "newsletter-signup")}"><p>{pick(some(4, 50))}</p><button>OK</button></{t}>'
    aside = lambda: one(f"<aside><h3>{pick(3)}</h3><p>{pick(some(3, 60))}</p></aside>", f'<div class="{one("sidebar", "widget", "related-posts", "share-bar")}"><h3>{pick(3)}</h3><ul>{links(3)}</ul><p>{pick(some(3, 60))}</p></div>', f'<div class="{cls("rail", "more", "related")}"><h3>{pick(2)}</h3><ul>{links(some(3, 8))}</ul></div>')
    form = lambda: f"<form><label>{pick(2)}</label><input name=q><p>{pick(some(2, 30))}</p><button>{pick(1)}</button></form>"
    comments = lambda: f'<{(t := one("section", "div"))} {one("class", "id")}="{one("comments", "comment-list", "discussion", "replies")}"><h2>{pick(2)}</h2>' + "".join(f'<{(u := one("div", "li", "article"))} class="comment"><p>{pick(some(3, 80))}</p></{u}>' for _ in range(some(1, 4))) + f"</{t}>"
    footer = lambda: one(f"<footer>&copy; {pick(4)} &middot; {pick(some(3, 30))}</footer>", f'<div class="{cls("footer", "site-footer", "colophon")}"><p>&copy; {pick(some(3, 30))}</p><p>{row(some(2, 6), " | ")}</p></div>', f'<div id="footer">{pick(8)}<a href=/p>{pick(2)}</a></div>')
    head = lambda: one("", f"<header><h2>{pick(3)}</h2><p>{pick(6)}</p></header>", f'<div class="{cls("site-header", "masthead", "topbar")}"><a href="/">{pick(3)}</a></div>')
    mark = "\x01"
    inside = lambda: one(f"<p>{pick(long(4, 200))}</p>", f"<p>{pick(long(4, 200))}", f"<p>{pick(long(20, 200))}</p>", f"<p><b>{pick(long(4, 80))}<br>", f"<h2>{pick(4)}</h2>", f"<h3>{pick(5)}</h3>", f"<blockquote><p>{pick(30)}</p></blockquote>", f"<ul><li>{pick(12)}</li><li>{pick(9)}</li></ul>", f"<ol><li>{pick(20)}</li><li>{pick(14)}</li><li>{pick(9)}</li></ol>", f'<p>{pick(20)} <a href="/l">{pick(3)}</a> {pick(30)}</p>', f"<table><tr><td>{pick(3)}</td><td>{pick(5)}</td></tr></table>", f"<pre>{pick(20)}</pre>", f"<figure><img src=i.png><figcaption>{pick(12)}</figcaption></figure>", f'<div class="{made()}"><p>{pick(some(10, 120))}</p></div>', f"{pick(some(20, 120))}<br><br>")
    cut = lambda: one(advert(), aside(), form(), comments(), notice(), menu())
    for _ in range(3):
        named = ("article", "article", "main", f'div class="{one("content", "post-content", "entry", "article-body", "story")}"', 'div id="content"', 'section class="post"')
        shell = one(f'div class="{made()}"', f'div id="{made()}"', f'section class="{made()}"', f'td class="{made()}"', "div") if plain_names and rng.random() < 0.6 else one(*named)
        least = 1 if shell in named else 4
        body = f"<h1>{pick(8)}</h1>" + "".join(f"{mark}{cut()}{mark}" if rng.random() < 0.12 else inside() for _ in range(some(least, 10)))
        if shell not in named:
            body += f"<p>{pick(long(12, 200))}</p><p>{pick(long(12, 150))}</p>"
        article = f"<{shell}>{body}</{shell.split()[0]}>"
        before = "".join(x() for x in (head, menu, notice, advert) if rng.random() < 0.6)
        after = "".join(x() for x in (comments, aside, form, advert) if rng.random() < 0.45) + footer()
        for _ in range(some(0, 3)):
            before, after = f"{before}<div class=\"{one('wrapper', 'container', 'page', 'row', made())}\">", f"{after}</div>"
        script = "<script>track(0);</script>" if rng.random() < 0.7 else ""
        if shell.startswith("td"):
            before, after = f"{before}<table><tr><td>{menu()}</td>", f"</tr></table>{after}"
        plain = f"<!DOCTYPE html><html><head><title>{pick(6)}</title>{script}</head><body>{before}\x02{article}\x02{after}</body></html>"
        page, places = "", {1: [], 2: []}
        for part in re.split(r"([\x01\x02])", plain):
            places[ord(part)].append(len(page)) if part in ("\x01", "\x02") else None
            page += "" if part in ("\x01", "\x02") else part
        nodes, runs = dom(page)
        begins = [start for start, _, ending, _, _ in Markup(page).tags() if ending == ""]
        if len(begins) != len(nodes) - 1:
            continue
        (first, last), cuts = places[2], list(zip(places[1][::2], places[1][1::2], strict=True))
        labels = [first <= b < last and not any(u <= b < v for u, v in cuts) for b in begins]
        yield page, labels


def text_runs(page: str) -> list[str]:
    """Up to RUNS text runs of a page, evenly spread, cut to RUN_CHARS characters."""
    runs = [t for _, t in dom(page.translate({1: " ", 2: " "}))[1] if t.strip()]
    return [t[:RUN_CHARS] for t in runs[:: max(1, -(-len(runs) // RUNS))]]


def sample(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> list[list[str]]:
    """Text runs of up to sample_pages different pages, by hash order; the driver gets hashes and runs, not pages."""
    pages = pages.select(F.col("html").cast("string").alias("html")).where("html <> ''").withColumn("h", F.xxhash64("html"))
    last = pages.select("h").distinct().orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
    if last is None:
        return []
    kind = pa.schema([("h", pa.int64()), ("runs", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array([text_runs(x) for x in batch["html"].to_pylist()], pa.list_(pa.string()))], schema=kind)

    picked = pages.where(F.col("h") <= last).dropDuplicates(["h"]).select("h", "html")
    return [r["runs"] for r in picked.mapInArrow(run, "h long, runs array<string>").orderBy("h").collect()]


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> gbt.Trees:
    """Fits the trees on layouts filled with text runs of the sample."""
    texts = [x for x in sample(pages, sample_pages) if x]
    xs, ys = [], []
    for k in range(sample_pages):
        for page, labels in layouts(texts[k] if k < len(texts) else [" ".join(FILLER[j:] + FILLER[:j]) * 5 for j in range(0, len(FILLER), 7)], k):
            nodes, runs = dom(page)
            judged, x = features(nodes, runs)
            xs.append(x)
            ys.append(np.array([labels[i - 1] for i in judged], float))
    return gbt.fit(np.concatenate(xs), np.concatenate(ys), trees=40, depth=5)


def extract_text(pages: DataFrame, model: gbt.Trees | None = None) -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    model = train(pages) if model is None else model
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = extract([x or "" for x in batch["html"].to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], schema=kind)

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string")
