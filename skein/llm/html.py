"""Main-text extraction from HTML by a minimum cut.

A page is split into text blocks at block-level tags. The graph has a node per block, and one per
element that is marked as content (article, main, classes such as post or story).

* Terminal capacities: a linear classifier rates each block by its own text (length, sentences, links,
  heading, paragraph) and by the elements around it that are marked as boilerplate (menus, asides, advert or
  comment classes and so on). A rating above 0 is the capacity to content, one below to boilerplate.
* Smoothness edges: neighbours in page order, and blocks under one parent, by ``SMOOTH`` over their DOM
  distance; and each block with the nearest content element above it (the page itself where it has none),
  unless boilerplate lies between.

Ratings and edges are on one scale: a short line's rating (down to -1) is less than what two neighbours and an
article outweigh, an advert's (about -4) more. Max-flow finds the cheapest labelling; blocks on the source side
are the article. So a class name alone doesn't drop article text: names are read by their last telling word
("comments-on-law" is about law), and what is marked both ways is left to text and neighbours.

Text rules: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by one space in page order. Null or empty pages and pages without content give ''.
Whole pages are read, in time linear in their length but for the flow: broken markup never fails (unclosed tags close with
their parents, stray ends are ignored; where a quote in a tag never closes, quotes in tags don't count from
there on). Every row is a page of its own, whatever its key; just the named columns are read, so further
ones can have any names. An empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"\b(class|id|role|itemprop|aria-hidden|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
STOP = re.compile(r"[>\"']")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "object", "title", "xmp", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: an opening tag closes an open one of these, up to the nearest container
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "body", "html", "td", "th", "li", "blockquote"}
#: a block-level tag closes an open paragraph
ENDS_P = BLOCKS - {"br", "button", "label", "legend", "option", "summary", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: classifier weights, and edge capacities in the same unit
TAGS = {"nav": -5.0, "aside": -5.0, "footer": -5.0, "form": -5.0, "menu": -5.0, "button": -5.0, "dialog": -5.0, "head": -5.0, "search": -5.0, "label": -3.0, "fieldset": -3.0}
MARKED, HINTED, LEAST = -4.5, -0.5, -5.0
SMOOTH, ARTICLE, CONTENT, PAGE, OUTSIDE = 1.2, 2.0, 1.2, 0.7, -0.6
GOOD = set("article content entry post story main body text articlebody hentry".split())
BAD = set("ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent copyright footer gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup promo promotion recommended recommendations related replies reply respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar widget alert".split())
#: words that say nothing about what their element holds
PLAIN = set("area bar block body box class col column container content group id inner item items layout left link links list mt outer panel right row section text title wrap wrapper".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    """A text block. ``low``: least depth since the block before it; ``home``: the content element above it, -1 if none."""

    text: str
    prior: float
    depth: int
    low: int
    parent: int
    home: int
    links: int
    heading: bool
    paragraph: bool


@dataclass
class _Open:
    tag: str
    prior: float
    ident: int
    home: int
    article: bool


def names_rating(value: str) -> tuple[bool, bool, float]:
    """Whether a class or id value marks content, whether it marks boilerplate, and what it hints at."""
    good, bad, hint = False, False, 0.0
    for name in value.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words:
            continue
        telling = list(words)
        while len(telling) > 1 and telling[-1] in PLAIN:
            telling.pop()
        last = telling[-1]
        if last in ("header", "title") and any(w in GOOD for w in telling[:-1]):
            good = True  # an article's own header holds its title
        elif last in BAD:
            bad = True
        elif last in GOOD:
            good = True
        elif any(w in BAD for w in words):
            hint = HINTED
    return good, bad, hint


def _rate(tag: str, attrs: str, above: _Open) -> tuple[float, bool, bool]:
    """What a new element adds to the rating of the text under it, whether it marks content, and boilerplate."""
    added = TAGS.get(tag, 0.0)
    good, bad = tag in ("article", "main"), added < -1
    if tag == "header" and not above.article:  # a page's header; an article's own one holds its title
        added, bad = MARKED, True
    if attrs:
        named_good = named_bad = False
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "itemprop"):
                if tag not in ("body", "html"):
                    g, b, hint = names_rating(value)
                    named_good, named_bad, added = named_good or g, named_bad or b, added + hint
            elif (name == "role" and value.lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                added, bad = added + LEAST, True
            elif name == "role" and value.lower() in ("main", "article"):
                good = True
        if named_bad and not named_good:
            added, bad = added + (MARKED / 2 if tag in HEADINGS or tag == "p" else MARKED), True
        good = good or (named_good and not named_bad)
    return added, good and not bad, bad


class _Scanner:
    """Finds the ends of tags and of raw elements, never looking twice for what isn't there."""

    def __init__(self, page: str):
        self.page, self.quotes, self.missing = page, True, set()

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none."""
        if self.quotes:
            i = at
            while (m := STOP.search(self.page, i)) is not None:
                if m.group() == ">":
                    return m.start()
                i = self.page.find(m.group(), m.end()) + 1
                if not i:
                    break
            self.quotes = False
        return self.page.find(">", at)

    def after_raw(self, tag: str, at: int) -> int | None:
        """The place after the end tag of ``tag``; None if there is none."""
        if tag in self.missing:
            return None
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if m is None:
            self.missing.add(tag)
            return None
        return m.end()


def blocks(page: str) -> tuple[list[Block], list[float]]:
    """Text blocks in page order, and the edge weight of each content element."""
    out: list[Block] = []
    homes: list[float] = []
    stack = [_Open("#", 0.0, 0, -1, False)]
    parts: list[str] = []
    links = linked = ids = at = 0
    low = 1  # least depth since the last block
    scan = _Scanner(page)
    n = len(page)

    def flush() -> None:
        nonlocal links, low
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                out.append(Block(text, top.prior, len(stack), low, stack[-2].ident if len(stack) > 1 else 0, top.home, links, any(o.tag in HEADINGS for o in stack[-3:]), any(o.tag == "p" for o in stack[-3:])))
                low = len(stack)
        links = 0

    def close(names: set[str], scopes: set[str]) -> None:
        """Closes the innermost open element among ``names``, with all inside it, unless one of ``scopes`` comes first."""
        nonlocal linked, low
        if not any(opened.get(x) for x in names):
            return  # so stray ends in deep pages cost nothing
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for o in stack[i:]:
                    opened[o.tag] -= 1
                    linked -= o.tag == "a"
                del stack[i:]
                low = min(low, len(stack))
                return
            if stack[i].tag in scopes:
                return

    opened: dict[str, int] = {}
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            parts.append(page[at:start])
            if linked:
                links += start - at
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        m = NAME.match(page, start + 1)
        if m is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:  # a plain less-than sign
                parts.append("<")
                at = start + 1
            continue
        end = scan.tag_end(m.end())
        if end < 0:
            break
        at = end + 1
        closing = m.group().startswith("/")
        tag = m.group().lstrip("/").lower()
        attrs = page[m.end() : end]
        if tag in RAW and not closing:
            if not attrs.endswith("/"):
                after = scan.after_raw(tag, at)
                at = after if after is not None else (n if tag in ("script", "style", "xmp") else at)
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if closing:
            close({tag}, set() if block else SCOPES)
        elif tag not in VOID:
            names, scopes = (CLOSES[tag], SCOPES - {tag}) if tag in CLOSES else ({"p"}, SCOPES) if tag in ENDS_P else (set(), SCOPES)
            close(names, scopes)
            ids += 1
            above = stack[-1]
            added, good, bad = _rate(tag, attrs, above)
            if not attrs.endswith("/") or block:
                home = -1 if bad else above.home
                if good:
                    homes.append(ARTICLE if tag == "article" else CONTENT)
                    home = len(homes) - 1
                stack.append(_Open(tag, max(LEAST, above.prior + added), ids, home, above.article or (good and tag == "article") or (good and tag != "main")))
                opened[tag] = opened.get(tag, 0) + 1
                linked += tag == "a"
    flush()
    return out, homes


def unary(b: Block, outside: bool) -> float:
    """The classifier's rating: above 0 speaks for content."""
    size = len(b.text)
    z = b.prior + min(size, 200) / 100.0 - 1.0 + 0.2 * min(4, sum(b.text.count(c) for c in ".!?"))
    z -= 1.5 * min(1.0, b.links / size)
    return z + 0.6 * b.heading + 0.2 * b.paragraph + OUTSIDE * outside


def min_cut(ratings: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (Dinic's blocking flows).

    Node i hangs on the source with capacity ``max(r, 0)`` and on the sink with ``max(-r, 0)``. Ties
    go to the sink side: only what the residual graph reaches from the source is content.
    """
    n = len(ratings)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(u: int, v: int, c: float, back: float) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, r in enumerate(ratings):
        if r > 0:
            add(s, i, r, 0.0)
        elif r < 0:
            add(i, t, -r, 0.0)
    for u, v, c in edges:
        if c > 0:
            add(u, v, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= eps)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(head[u]):
                e = head[u][nxt[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(head[u]):
                path.append(head[u][nxt[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def graph(page: str) -> tuple[list[Block], list[float], list[tuple[int, int, float]]]:
    """Blocks, ratings (blocks first, then content elements, then the page) and edges."""
    found, homes = blocks(page)
    n = len(found)
    inside = [b.home >= 0 for b in found]
    marked = any(inside)
    ratings = [unary(b, marked and not k) for b, k in zip(found, inside, strict=True)]
    edges = []
    pull = [0.0] * (len(homes) + 1)
    latest: dict[int, int] = {}
    for i, b in enumerate(found):
        for back in (1, 2):
            if i >= back:
                low = min(x.low for x in found[i - back + 1 : i + 1])
                distance = found[i - back].depth + b.depth - 2 * min(low, found[i - back].depth, b.depth)
                edges.append((i - back, i, SMOOTH / (back * (1 + distance))))
        before = latest.get(b.parent)
        if before is not None and before < i - 2:
            edges.append((before, i, SMOOTH / 3))
        latest[b.parent] = i
        if inside[i]:
            edges.append((n + b.home, i, homes[b.home]))
            pull[b.home] += homes[b.home]
        elif not marked and b.prior > MARKED / 2:
            edges.append((n + len(homes), i, PAGE))
            pull[-1] += PAGE
    # a content element counts as content for certain: it gives as much as its edges can take
    return found, ratings + pull, edges


def labels(page: str) -> list[tuple[str, float, bool]]:
    """Text, rating and verdict of each block."""
    found, ratings, edges = graph(page)
    return [(b.text, r, k) for b, r, k in zip(found, ratings, min_cut(ratings, edges), strict=False)]


def main_text(page: str | None) -> str:
    """The article of one page."""
    return " ".join(t for t, _, k in labels(page) if k) if page else ""


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, ``keep``, ``text``, ``n_chars`` per page; nothing is shuffled."""
    kept = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column(1)]
            yield pa.record_batch([b.column(0), *b.columns[2:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["key", *b.schema.names[2:], "text", "n_chars"])

    schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ["key", *[f"k{i}" for i in range(len(keep))]]) + ", text string, n_chars long"
    out = kept.mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
