"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes and hierarchical decoding.

A tolerant parser makes a tree of block elements and runs of inline text. Features of a node: subtree densities (text, links,
tags, punctuation, list items, form fields), tag, tokens of its id and class and of its ancestors', depth, and statistics of
its siblings. Trees give each node probabilities of three states: all of it is main text, none is, or its children decide.
Decoding finds the likeliest states of the whole tree under which all descendants of a kept node are kept and all of a dropped
node dropped, so ancestors and descendants never contradict each other.

The trees are trained here, on pages that a seeded generator writes with known main texts: many layouts, with and without
telling tags and attributes. Scripts, styles, templates, titles and comments are never text.

Scale: a map over pages; the trees are a few hundred KB.

Defined cases: a null or empty html gives the empty text; character references are decoded, white space inside a block becomes
one space, blocks are joined by line feeds; unclosed and misnested tags are closed as they must be, and what an element that is not
shown hides ends with the element around it; repeated rows keep a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.boosting import BoostedTrees

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)", re.S)
ATTR = re.compile(r"\b(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# fixed values: the HTML standard's void elements, elements of raw or unshown text, and elements of inline text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title textarea select option svg iframe object canvas audio video head".split())
ENDLESS = frozenset("select object canvas audio video".split())  # hidden only if an end tag follows
RAW = frozenset("script style textarea title noscript template iframe svg".split())
IN_HEAD = frozenset("base basefont bgsound link meta html head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input button picture center".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
TAGS = "div p h1 h2 h3 h4 ul ol li nav article main section aside header footer form table tr td blockquote pre figure figcaption dl body html #text".split()
FIELDS = frozenset("input button select textarea label option".split())
TOKENS = (
    "article content post entry story main body text blog news page wrapper container nav menu sidebar side footer header head foot ad ads advert advertisement banner promo sponsor sponsored "
    "comment comments reply discussion cookie consent notice alert popup modal newsletter subscribe signup login search form related recommended more share social breadcrumb breadcrumbs "
    "pagination pager tags meta author byline widget copyright legal masthead topbar toolbar links list teaser disclaimer warning message hero"
).split()
TOKEN_AT = {t: i for i, t in enumerate(TOKENS)}
TAG_AT = {t: i for i, t in enumerate(TAGS)}
SPLIT = re.compile(r"[^a-z]+")
BASIC = 20
WIDTH = BASIC + len(TAGS) + 2 * len(TOKENS) + 8
ABOVE = {t: i for i, t in enumerate("nav aside footer header form article main table".split())}
KEEP, DROP, MIXED = 0, 1, 2


class Node:
    __slots__ = ("above", "attrs", "children", "depth", "fields", "items", "linked", "paragraphs", "parent", "parts", "start", "tag", "tags", "text", "truth", "words")

    def __init__(self, tag: str, parent: Node | None, attrs: list[int]):
        self.tag, self.parent, self.children, self.attrs = tag, parent, [], attrs
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list[str] | None = None
        self.text, self.truth = "", None
        self.linked = self.fields = self.tags = 0
        if parent:
            parent.children.append(self)


def parse(html: str, mark: str = "") -> Node:
    """The tree; mark: words that contain it are main text, for training."""
    root = Node("html", None, [])
    stack = [root]  # open elements, inline ones too
    block, run, links = root, None, 0
    blocks, block_at = [root], [0]  # open blocks and where in the stack they are
    inlines: list[Counter[str]] = [Counter()]  # open inline elements of each open block
    end = 0
    skip: str | None = None
    inner: list[str] = []  # open elements of the element that is skipped
    within: Counter[str] = Counter()  # and how many of each name
    opened: Counter[str] = Counter()  # open elements by name
    last_end: dict[str, int] = {}

    def text(s: str) -> None:
        nonlocal run
        if run is None:
            if not s.strip():
                return
            run = Node("#text", blocks[-1], [])
            run.parts = []
        run.parts.append(unescape(s))
        if links:
            run.linked += len(s)

    def close(upto: int) -> None:
        nonlocal run, links
        while len(stack) > upto:
            item = stack.pop()
            opened[tag_of(item)] -= 1
            if isinstance(item, Node):
                blocks.pop()
                block_at.pop()
                inlines.pop()
                run = None
                continue
            inlines[-1][item] -= 1
            if item == "a":
                links -= 1

    def tag_of(item: Node | str) -> str:
        return item.tag if isinstance(item, Node) else item

    def past(tag: str) -> int:
        stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, end)
        return stop.end() if stop else (len(html) if tag not in ("noscript", "svg", "template") else end)

    def ends_later(tag: str) -> bool:
        """Whether an end tag of that name follows."""
        if tag not in last_end:
            last_end[tag] = html.lower().rfind(f"</{tag}")
        return last_end[tag] >= end

    def omitted(closing: str, tag: str) -> bool:
        """Whether the tag ends a skipped element without its own end tag: a head or option, whose end tags may be left out, or
        one that an element around it ends with."""
        if skip == "head":
            return tag in ("body", "html", "br") if closing else tag not in IN_HEAD
        if not closing:
            if skip == "option" and tag == "option":
                inner.clear()
                within.clear()
            elif tag not in VOID:
                inner.append(tag)
                within[tag] += 1
            return skip == "option" and tag in ("optgroup", "hr")
        if within[tag] > 0:
            while True:
                gone = inner.pop()
                within[gone] -= 1
                if gone == tag:
                    return False
        return tag != skip and opened[tag] > 0

    for m in TOKEN.finditer(html):
        if m.start() < end:
            continue
        if skip == "head" and html[end : m.start()].strip():
            skip = None
        if m.start() > end and skip is None:
            text(html[end : m.start()])
        end = m.end()
        if not m[2]:
            continue
        closing, tag = m[1], m[2].lower()
        if skip is not None and not closing and tag in RAW:
            end = past(tag)
            continue
        if skip is not None:
            nested = within[tag] > 0
            if omitted(closing, tag):
                skip = None
            else:
                if closing and tag == skip and not nested:
                    skip = None
                continue
        if closing:
            if tag == "br" or not (inlines[-1] if tag in INLINE else opened)[tag]:
                continue
            at = len(stack) - 1
            while tag_of(stack[at]) != tag:
                at -= 1
            close(at)
            continue
        if tag in ("html", "body") and len(stack) > 1 and tag_of(stack[-1]) != "html":
            continue
        if tag == "html":
            continue
        if tag in RAW:
            end = past(tag)
            continue
        if tag in FIELDS:
            blocks[-1].fields += 1
        if tag in VOID:
            if tag in ("br", "hr") and run is not None:
                run.parts.append(" ")
            if tag == "hr":
                run = None
            continue
        if tag in HIDDEN:
            if not m[3].rstrip().endswith("/") and (tag not in ENDLESS or ends_later(tag)):
                skip = tag
                inner.clear()
                within.clear()
            continue
        if tag in CLOSES_P and blocks[-1].tag == "p":
            close(block_at[-1])
        if tag in SAME:
            names, stops = SAME[tag]
            for i in range(len(stack) - 1, 0, -1):
                if tag_of(stack[i]) in names.split():
                    close(i)
                    if tag != "tr":
                        break
                elif tag_of(stack[i]) in stops:
                    break
        if tag in INLINE:
            blocks[-1].tags += 1
            if tag == "a":
                links += 1
            stack.append(tag)
            opened[tag] += 1
            inlines[-1][tag] += 1
            continue
        attrs = []
        if "=" in m[3]:
            for a in ATTR.finditer(m[3]):
                attrs += [TOKEN_AT[t] for t in SPLIT.split((a[2] or a[3] or a[4] or "").lower()) if t in TOKEN_AT]
        run = None
        node = Node(tag, blocks[-1], attrs)
        stack.append(node)
        opened[tag] += 1
        blocks.append(node)
        block_at.append(len(stack) - 1)
        inlines.append(Counter())
    if skip in (None, "head") and end < len(html):
        text(html[end:])
    _settle(root, mark)
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += n.children[::-1]
    return out


def _settle(root: Node, mark: str) -> None:
    """Sums over subtrees, and places in the page."""
    nodes, at = walk(root), 0
    for n in nodes:
        n.start = at
        if n.parts is not None:
            n.text = " ".join("".join(n.parts).split())
            at += len(n.text)
            n.words = n.text.count(" ") + 1 if n.text else 0
            n.linked = min(n.linked, len(n.text))
            if mark:
                inside = n.text.count(mark)
                n.truth = (inside, n.words - inside)
        else:
            n.words = 0
            n.truth = (0, 0)
        n.paragraphs, n.items = int(n.tag == "p"), int(n.tag == "li")
    size = {}
    for n in reversed(nodes):
        total = len(n.text)
        n.tags += 1
        for c in n.children:
            total += size[id(c)][0]
            n.words += c.words
            n.linked += c.linked
            n.fields += c.fields
            n.tags += c.tags
            n.paragraphs += c.paragraphs
            n.items += c.items
            if mark:
                n.truth = (n.truth[0] + c.truth[0], n.truth[1] + c.truth[1])
        stops = n.text.count(".") + n.text.count(",") + n.text.count(";") + sum(size[id(c)][1] for c in n.children)
        size[id(n)] = (total, stops)
    for n in nodes:
        n.above = size[id(n)]


def featured(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node of a page (walk order)."""
    x = np.zeros((len(nodes), WIDTH), np.float32)
    whole = max(nodes[0].above[0], 1)
    inherited: dict[int, tuple[frozenset, frozenset]] = {}
    for row, n in zip(x, nodes, strict=True):
        size, stops = n.above
        siblings = n.parent.children if n.parent else [n]
        i = siblings.index(n) if len(siblings) < 50 else min(50, next((k for k, s in enumerate(siblings[:50]) if s is n), 50))
        before = siblings[i - 1] if i and i < 50 else None
        after = siblings[i + 1] if i + 1 < len(siblings) and i < 50 else None
        row[0:BASIC] = (
            n.depth, n.start / whole, np.log1p(size), n.linked / max(size, 1), np.log1p(n.tags), size / max(n.tags, 1), stops / max(n.words, 1),
            n.words / max(n.paragraphs, 1), np.log1p(n.paragraphs), i, np.log1p(len(siblings)), size / max(n.parent.above[0], 1) if n.parent else 1,
            np.log1p(before.above[0]) if before else -1, np.log1p(after.above[0]) if after else -1,
            before.linked / max(before.above[0], 1) if before else -1, n.fields, n.items / max(n.tags, 1), size / whole, not n.children, n.fields * 20 / (size + 20),
        )
        tag = TAG_AT.get(n.tag)
        if tag is not None:
            row[BASIC + tag] = 1
        base = BASIC + len(TAGS)
        row[[base + a for a in n.attrs]] = 1
        tags, attrs = inherited.get(id(n.parent), (frozenset(), frozenset()))
        row[[base + len(TOKENS) + a for a in attrs]] = 1
        row[[WIDTH - 8 + t for t in tags]] = 1
        inherited[id(n)] = (tags | {ABOVE[n.tag]} if n.tag in ABOVE else tags, attrs.union(n.attrs) if n.attrs else attrs)
    return x


def decode(nodes: list[Node], logp: np.ndarray) -> list[int]:
    """The likeliest consistent states, by dynamic programming over the tree."""
    at = {id(n): i for i, n in enumerate(nodes)}
    keep, drop, free = logp[:, KEEP].copy(), logp[:, DROP].copy(), logp[:, MIXED].copy()
    for i in range(len(nodes) - 1, -1, -1):
        below = [at[id(c)] for c in nodes[i].children]
        if not below:
            free[i] = -np.inf
        for c in below:
            keep[i] += keep[c]
            drop[i] += drop[c]
            free[i] += max(keep[c], drop[c], free[c])
    state = [MIXED] * len(nodes)
    for i, n in enumerate(nodes):
        up = state[at[id(n.parent)]] if n.parent else MIXED
        state[i] = up if up != MIXED else int(np.argmax((keep[i], drop[i], free[i])))
    return state


class Extractor:
    """The trees and the way from a page to its main text."""

    def __init__(self, trees: BoostedTrees):
        self.trees = trees

    def texts(self, pages: list[str | None]) -> Iterator[str]:
        for a in range(0, len(pages), 64):
            walked = [walk(parse(h)) if h else [] for h in pages[a : a + 64]]
            full = [w for w in walked if w]
            if full:
                logp = self.trees.log_probabilities(np.concatenate([featured(w) for w in full]))
            place = 0
            for w in walked:
                if not w:
                    yield ""
                    continue
                state = decode(w, logp[place : place + len(w)])
                place += len(w)
                yield "\n".join(n.text for n, s in zip(w, state, strict=True) if s == KEEP and n.text)


# ---- training pages ----

MARK = "⁣"


class _Writer:
    """Writes pages of random words; words of main text carry the mark."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *options: str) -> str:
        return options[self.r.integers(len(options))]

    def words(self, low: int, high: int, mark: str = "", stops: bool = True) -> str:
        out = []
        for _ in range(int(self.r.integers(low, high + 1))):
            w = "".join(self.r.choice(list("etaoinshrdlcumwfgypb"), self.r.integers(2, 10))) + mark
            out.append(w + (self.pick(".", ",", "", "", "", "", "") if stops else ""))
        return " ".join(out)

    def attrs(self, *names: str, often: float = 0.75) -> str:
        if self.r.random() > often:
            return ""
        name = self.pick(*names)
        return f' {self.pick("class", "class", "id")}="{self.pick("", "site-", "c-", "js ")}{name}{self.pick("", "", "-1", " box")}"'

    def inline(self, s: str) -> str:
        w = s.split(" ")
        for i in range(len(w)):
            if self.r.random() < 0.03:
                t = self.pick("a", "b", "em", "span", "i")
                w[i] = f'<{t}{" href=#" if t == "a" else ""}>{w[i]}</{t}>'
            elif self.r.random() < 0.01:
                w[i] += self.pick("<br>", "<b>", "&amp;")
        return " ".join(w)

    def links(self, n: int) -> str:
        tag = self.pick("ul", "ul", "div", "ol")
        one = "li" if tag != "div" else self.pick("span", "div", "p")
        return f"<{tag}>" + "".join(f'<{one}><a href="/{i}">{self.words(1, 4, stops=False)}</a></{one}>' for i in range(n)) + f"</{tag}>"

    def article(self) -> str:
        out = [f"<h1>{self.words(3, 10, MARK)}</h1>"] if self.r.random() < 0.85 else []
        paragraph = self.pick("p", "p", "p", "p", "div")
        for _ in range(int(self.r.choice([1, 2, 4, 8, 14]))):
            kind = self.r.random()
            if kind < 0.78:
                out.append(f"<{paragraph}>{self.inline(self.words(1, int(self.r.choice([4, 20, 60, 120])), MARK))}" + (f"</{paragraph}>" if self.r.random() < 0.9 or paragraph == "div" else ""))
            elif kind < 0.86:
                h = self.pick("h2", "h3", "h4")
                out.append(f"<{h}>{self.words(1, 6, MARK)}</{h}>")
            elif kind < 0.92:
                t = self.pick("ul", "ol")
                out.append(f"<{t}>" + "".join(f"<li>{self.words(2, 15, MARK)}</li>" for _ in range(self.r.integers(2, 6))) + f"</{t}>")
            elif kind < 0.95:
                out.append(f"<blockquote><p>{self.words(5, 40, MARK)}</p></blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4, MARK)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<figure><img src=x><figcaption>{self.words(3, 12, MARK)}</figcaption></figure>")
            if self.r.random() < 0.05:
                out.append(self.advert() if self.r.random() < 0.6 else self.box())
        return "".join(out)

    def advert(self) -> str:
        t = self.pick("div", "div", "aside", "section")
        body = self.words(2, 25)
        body = self.pick(body, f"<p>{body}</p>", f'<a href="#">{body}</a>')
        return f"<{t}{self.attrs('ad', 'ads', 'advert', 'advertisement', 'banner', 'promo', 'sponsored', often=1)}>{body}</{t}>"

    def box(self) -> str:
        kind = self.pick("related", "share", "newsletter", "notice", "cookie")
        if kind in ("related", "share"):
            return f"<{(t := self.pick('div', 'aside', 'section'))}{self.attrs('related', 'share', 'social', 'recommended', 'more-links', often=0.95)}>{self.pick('', f'<h3>{self.words(1, 3, stops=False)}</h3>')}{self.links(int(self.r.integers(2, 7)))}</{t}>"
        if kind == "newsletter":
            return self.form()
        return f"<div{self.attrs('notice', 'alert', 'cookie-notice', 'cookie-consent', 'popup', 'disclaimer', 'message', often=1)}><p>{self.words(4, 40)}</p>{self.pick('', '<button>ok</button>')}</div>"

    def form(self) -> str:
        inner = "".join(f"<label>{self.words(1, 3, stops=False)}</label><input name=a>" for _ in range(self.r.integers(1, 4)))
        lead = self.pick("", f"<p>{self.words(3, 15)}</p>", self.words(2, 10))
        return f"<form{self.attrs('search', 'login', 'newsletter', 'signup', 'subscribe', often=0.6)}>{lead}{inner}<button>{self.words(1, 2, stops=False)}</button></form>"

    def comments(self) -> str:
        t = self.pick("section", "div", "div", "aside", "ol")
        one = "li" if t == "ol" else self.pick("div", "article", "div")
        named = self.attrs("comment", "reply", "comment-body", often=0.8)
        body = "".join(f"<{one}{named}>{self.pick('', f'<h4>{self.words(1, 2, stops=False)}</h4>', f'<b>{self.words(1, 2)}</b>')}<p>{self.inline(self.words(2, 50))}</p></{one}>" for _ in range(self.r.integers(1, 7)))
        return f"<{t}{self.attrs('comments', 'discussion', 'comment-list', often=0.97)}>{self.pick('', f'<h3>{self.words(1, 3, stops=False)}</h3>')}{body}{self.form() if self.r.random() < 0.3 else ''}</{t}>"

    def page(self) -> str:
        some = lambda p, f: f() if self.r.random() < p else ""
        nav = lambda: (lambda t: f"<{t}{self.attrs('nav', 'menu', 'navbar menu', 'topbar', 'breadcrumbs', often=0.9 if t == 'div' else 0.4)}>{self.links(int(self.r.integers(2, 12)))}</{t}>")(self.pick("nav", "nav", "div"))
        head = lambda: (lambda t: f"<{t}{self.attrs('header', 'masthead', 'page-header', 'topbar', often=1 if t == 'div' else 0.4)}>{self.pick(f'<h1>{self.words(1, 4, stops=False)}</h1>', self.words(1, 5, stops=False), f'<p>{self.words(2, 8)}</p>')}{some(0.5, nav)}</{t}>")(self.pick("header", "header", "div"))
        side = lambda: (lambda t: f"<{t}{self.attrs('sidebar', 'side', 'widget', often=1 if t == 'div' else 0.5)}>{some(0.5, lambda: f'<h3>{self.words(1, 3)}</h3>')}{some(0.7, lambda: self.links(4))}{some(0.4, lambda: f'<p>{self.words(3, 40)}</p>')}</{t}>")(self.pick("aside", "div"))
        foot = lambda: (lambda t: f"<{t}{self.attrs('footer', 'copyright', 'foot', 'legal', often=1 if t == 'div' else 0.3)}>{some(0.4, lambda: self.links(4))}{self.pick(f'&copy; {self.words(1, 15)}', f'<p>{self.words(2, 25)}</p>')}</{t}>")(self.pick("footer", "footer", "div"))
        t = self.pick("article", "article", "article", "main", "div", "section")
        inside = f"<{t}{self.attrs('article', 'content', 'post', 'entry-content', 'story', 'post-body', 'article-text', often=0.95 if t in ('div', 'section') else 0.3)}>{self.article()}{some(0.12, self.comments)}{some(0.08, self.box)}"
        inside += f"</{t}>"
        if self.r.random() < 0.4:
            outer = self.pick("main", "div")
            inside = f"<{outer}{self.attrs('main', 'wrapper', 'container', 'page')}>{some(0.2, nav)}{inside}{some(0.3, self.comments)}{some(0.3, side)}</{outer}>"
        parts = [some(0.6, head), some(0.7, nav), some(0.35, self.advert), some(0.2, self.box), some(0.25, side), inside, some(0.25, self.comments), some(0.2, self.form), some(0.25, self.advert), some(0.2, side), some(0.75, foot), some(0.1, self.box)]
        ends = "</body></html>" if self.r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><script>var a;</script></head><body>{''.join(parts)}{ends}"


def training_pages(n: int, seed: int) -> list[str]:
    writer = _Writer(seed)
    return [writer.page() for _ in range(n)]


def states(nodes: list[Node]) -> list[int]:
    return [DROP if not n.truth[0] else KEEP if not n.truth[1] else MIXED for n in nodes]


@lru_cache(2)
def trained(pages: int = 320, seed: int = 3) -> Extractor:
    """The extractor, from pages with known main texts."""
    xs, ys = [], []
    for html in training_pages(pages, seed):
        nodes = walk(parse(html, MARK))
        xs.append(featured(nodes))
        ys += states(nodes)
    return Extractor(BoostedTrees(3).fit(np.concatenate(xs), np.array(ys)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' page_id and url with the columns text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(shared.value.texts(batch.column("html").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
