"""Main-text extraction by composite text density.

Each node of the page's tree gets its characters per tag, lowered by the share that stands in links. A node's density sum
adds its children's densities; the node with the largest sum holds the article. The lowest density on the path from it to
the body is the threshold: elsewhere, subtrees at or over it are kept too, where the largest sum of their branch lies.

Elements whose very name says that they hold no article text (menus, forms, scripts and so on) leave the tree before the
densities are computed. Words in a class or id are a weak prior only: they lower a node's density, unless the node holds
much of the page's text; what then stays under the threshold goes. Every step is linear in the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

# fixed values: element names of HTML
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "script", "small", "span", "strike", "strong", "style", "sub", "sup", "template", "time", "tt", "u", "var", "wbr"}
DROPPED = {"head", "script", "style", "noscript", "template", "title", "nav", "aside", "footer", "form", "button", "select", "option", "textarea", "input", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "map", "menu", "dialog", "xmp", "noembed", "noframes"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert", "dialog", "form"}
#: Names of what surrounds an article, as the first or last part of a class or id: the prior.
BOILERPLATE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "banner", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer", "masthead", "topbar", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "disqus", "respond", "replies", "widget", "pagination", "pager", "toolbar", "disclaimer"}
#: First parts of a class that says something about a page instead of naming a part of it.
STATES = {"no", "not", "with", "without", "has", "is", "show", "hide", "hides", "shows", "can", "js"}
#: How much the prior lowers a density, and the share of the page's text from which on it says nothing, unless an article stands elsewhere: for a part of a name, and for a whole name.
PRIOR, MOST = 0.25, {1: 0.5, 2: 0.9}
#: An element of the first kind ends an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = ("ul", "ol", "dl", "table", "html", "body", "td", "th", "article", "section", "div", "main", "aside", "nav")

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STEP = re.compile(r"""[^>"'=]*""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """The tree of a page; nodes are numbered in page order, the root is 0. pieces: (node, text), or (node, None) where a block begins or ends."""

    names: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [0])
    dropped: list[bool] = field(default_factory=lambda: [False])
    prior: list[int] = field(default_factory=lambda: [0])  # 1: a part of a class or id names boilerplate, 2: one as a whole
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


def _judge(name: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is out by its name or state, and how its class or id names boilerplate."""
    out, prior = name in DROPPED or name == "header" and not in_article, 0
    for m in _ATTR.finditer(attrs) if attrs and not out and not attrs.isspace() else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value) or key == "role" and value in ROLES:
            out = True
        if key in ("class", "id") and name not in ("html", "body"):
            for token in value.split():
                parts = [p for p in re.split(r"[^a-z]+", token) if p]
                if token in BOILERPLATE:
                    prior = 2
                elif parts and parts[0] not in STATES and (parts[0] in BOILERPLATE or parts[-1] in BOILERPLATE):
                    prior = max(prior, 1)
    return out, prior


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag, or -1: quotes around a value hide it."""
    after_equals = False
    while True:
        at = _STEP.match(page, at).end()
        if at >= len(page):
            return -1
        c = page[at]
        if c == ">":
            return at
        if c == "=":
            after_equals = True
            at += 1
            while at < len(page) and page[at].isspace():
                at += 1
            if at < len(page) and page[at] in "\"'":
                at = page.find(page[at], at + 1)
                if at < 0:
                    return -1
                at += 1
            continue
        at += 1  # a quote that opens no value


def parse(page: str) -> Page:
    """The page's tree, as browsers read loose markup: unclosed paragraphs, list items and cells end where the next begins."""
    out = Page()
    stack, blocks = [0], [0]  # open nodes, and the depths of the open blocks
    open_at: dict[str, list[int]] = defaultdict(list)  # depths of the open nodes, by name
    loose = False  # a tag without end was met: quotes no longer count
    at, n = 0, len(page)
    raw_end: dict[str, re.Pattern] = {}

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            open_at[out.names[node]].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
                out.pieces.append((out.parent[node], None))

    def text(a: int, b: int) -> None:
        if b > a:
            out.pieces.append((stack[-1], html.unescape(page[a:b])))

    start = 0  # of the text not yet taken
    while (at := page.find("<", at)) >= 0:
        m = _NAME.match(page, at + 1)
        if m is None:
            if page[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1
                continue
            text(start, at)
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = start = end + 3 if end >= 0 else n
            else:
                end = page.find(">", at)
                at = start = end + 1 if end >= 0 else n
            continue
        end = page.find(">", at) if loose else _tag_end(page, m.end())
        if end < 0 and not loose:
            loose = True
            end = page.find(">", at)
        if end < 0:
            break  # no tag ends from here on
        text(start, at)
        name, attrs = m[0].lower(), page[m.end() : end]
        at = start = end + 1
        if name[0] == "/":
            if open_at[name[1:]]:
                close(open_at[name[1:]][-1])
            continue
        if name == "html":
            continue
        block = name not in INLINE
        if block and name not in VOID:
            if out.names[stack[blocks[-1]]] == "p":  # a block ends an open paragraph, whatever inline elements stand open in it
                close(blocks[-1])
            if name in CLOSES:
                scope = max((open_at[s][-1] for s in SCOPES if s not in CLOSES[name] and open_at[s]), default=0)
                # the outermost open one within the scope: a row ends its cells as well
                found = [d[bisect_right(d, scope)] for d in (open_at[s] for s in CLOSES[name]) if d and d[-1] > scope]
                if found:
                    close(min(found))
        up = stack[-1]
        node = len(out.names)
        gone, prior = (True, 0) if out.dropped[up] else _judge(name, attrs, bool(open_at["article"]))
        out.names.append(name)
        out.parent.append(up)
        out.dropped.append(gone)
        out.prior.append(prior)
        if block:
            out.pieces.append((up, None))
        if name in VOID or attrs.endswith("/") and name not in RAW and name not in INLINE and name not in ("p", "div"):
            continue
        if name in RAW:
            if name not in raw_end:
                raw_end[name] = re.compile(rf"</{name}\b[^>]*>", re.I)
            found = raw_end[name].search(page, at)
            at = start = found.end() if found else n
            continue
        if block:
            blocks.append(len(stack))
        open_at[name].append(len(stack))
        stack.append(node)
    text(start, n)
    return out


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Density and density sum of each node; dropped nodes have none. Inline elements are text of their block and add to no sum."""
    n = len(page.names)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in page.pieces:
        if text is not None:
            chars[node] += len(text.strip())
    for i in range(n - 1, 0, -1):  # children before their parents
        if page.dropped[i]:
            chars[i] = 0
            continue
        if page.names[i] == "a":
            link_chars[i], link_tags[i] = chars[i], tags[i]
        up = page.parent[i]
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i] + (page.names[i] == "a")
    articles = [int(page.names[i] in ("article", "main") and chars[i] > 0) for i in range(n)]
    n_articles, around = sum(articles), articles[:]
    for i in range(1, n):
        around[i] += around[page.parent[i]]
    for i in range(n - 1, 0, -1):
        articles[page.parent[i]] += articles[i]
    body = _body(page)
    lean = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c = chars[i]
        if page.dropped[i] or not c:
            continue
        t, lc, lt = max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
        base = log(c / max(1, c - link_chars[i]) * link_chars[i] + lean * c + e)
        density[i] = c / t * max(0.0, log(max(1.0, c / lc * t / lt))) / base
        own = page.names[i] in ("article", "main")  # in both counts
        if page.prior[i] and (c < MOST[page.prior[i]] * chars[body] or n_articles > articles[i] + around[i] - own):
            density[i] *= PRIOR
        if i and page.names[i] not in INLINE:
            total[page.parent[i]] += density[i]
    return density, total


def _body(page: Page) -> int:
    return page.names.index("body") if "body" in page.names else 0


def choose(page: Page) -> list[bool]:
    """Which nodes' texts are kept."""
    n = len(page.names)
    density, total = densities(page)
    best = list(range(n))  # of each subtree: the node with the largest sum, the first in page order if they tie
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if not page.dropped[i] and total[best[i]] >= total[best[up]] and (total[best[i]] > total[best[up]] or best[i] < best[up]):
            best[up] = best[i]
    body = _body(page)
    top = best[0] if total[best[0]] > 0 else body  # bare text without elements
    threshold, up = density[top], top
    while up not in (body, 0):
        up = page.parent[up]
        threshold = min(threshold, density[up])
    chosen = [False] * n
    chosen[top] = True
    for i in range(body, n):
        if not page.dropped[i] and density[i] >= threshold and density[i] > 0:
            chosen[best[i] if total[best[i]] > 0 else i] = True
    kept, out = [False] * n, page.dropped[:]
    for i in range(n):
        up = page.parent[i]
        # a low node goes with all it holds; the chosen one lies in none, as the threshold is the least on its path
        out[i] = out[i] or out[up] or page.prior[i] > 0 and density[i] < threshold
        kept[i] = not out[i] and (chosen[i] or i > 0 and kept[up])
    return kept


def extract(page: str | None) -> str:
    """The page's main text: blocks in page order, joined by one space; empty for null, empty or textless pages."""
    if not page:
        return ""
    tree = parse(page)
    kept = choose(tree)
    blocks: list[list[str]] = [[]]
    for node, text in tree.pieces:
        if text is None:
            blocks.append([])
        elif kept[node]:
            blocks[-1].append(text)
    found = (" ".join("".join(b).split()) for b in blocks if b)
    return " ".join(b for b in found if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row; repeated rows give repeated results, other columns are not carried.

    Null and empty pages give an empty text. Of nodes with equal sums the first in page order is chosen. An empty table
    gives an empty result.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            text = [extract(h) for h in df["html"]]
            yield pd.DataFrame({"page_id": df["page_id"], "url": df["url"], "text": text, "n_chars": [len(t) for t in text]})

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))
