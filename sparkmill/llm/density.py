"""Main text of web pages by composite text density.

A page becomes a tree of its tags (implied ends of paragraphs, list items and cells
are filled in).  Parts whose tag, role or class name says that they are no article
(navigation, notices, adverts, forms, reader comments ...) are cut off.  Every other
node has a density: its characters per tag, adjusted by how many of both belong to
links, against the share of links in the whole body.  The node whose children have
the largest sum of densities is the heart of the page.  The smallest density on its
way up to the body is the threshold: nodes of its kind (tag and class) that reach it
belong to the text as well.  Where the heart lies in an ``article`` (or ``main``) the
text is all of that element; without such an element, blocks inside the selected nodes that
consist mostly of links and stay below the threshold go.

A page is parsed in one pass without recursion; Spark deals the pages to tasks and
nothing is shuffled.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import ship

# Kinds of tags (HTML standard) and names by which pages mark what is not the article.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend",
         "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
CELL = {"td", "th"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title"}
CUT_TAGS = {"aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "menu", "nav", "noscript", "object",
            "script", "search", "select", "style", "svg", "template", "textarea", "title"}
CUT_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
CUT_NAMES = {"ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
             "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation",
             "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related",
             "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
NEGATIVE = {"has", "no", "not", "with", "without"}

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_NAME = re.compile(r"[\s/]*([^\s/>=]*)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A start tag of the first kind ends an open one of the second, up to the third.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for t in ("thead", "tbody", "tfoot")}}


def _attributes(html: str, at: int) -> tuple[dict[str, str], int] | None:
    """Attributes from ``at`` on and the place after the tag's end; None where the page ends inside the tag."""
    found: dict[str, str] = {}
    while at < len(html):
        if html[at] == ">":
            return found, at + 1
        m = _NAME.match(html, at)
        at, value = m.end(), ""
        if m[2]:
            if html[at: at + 1] in ('"', "'"):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1: end], end + 1
            else:
                value = _BARE.match(html, at)[0]
                at += len(value)
        if m[1]:
            found.setdefault(m[1].lower(), value)
    return None


def _named(tag: str, attributes: dict[str, str]) -> bool:
    """Whether role, class or id say that the element is no part of an article."""
    if attributes.get("role", "").strip().lower() in CUT_ROLES:
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in NEGATIVE and CUT_NAMES & {words[0], words[-1]}:
            return True
    return False


class Page:
    """Nodes in page order: parent, tag, whether named as no article, tag and class; and the page's texts as events."""

    def __init__(self, html: str):
        self.parent, self.tag, self.named, self.sign = [-1], ["html"], [False], [("html", "")]
        #: Events in page order: (node, text) or (node, None) where a block begins or ends.
        self.events: list[tuple[int, str | None]] = []
        self.body = 0
        self._stack, self._open = [0], Counter(["html"])
        self._parse(html)

    def _pop(self) -> None:
        node = self._stack.pop()
        self._open[self.tag[node]] -= 1
        if self.tag[node] in BLOCK:
            self.events.append((self._stack[-1] if self._stack else 0, None))

    def _pop_to(self, tags: set[str], stop: set[str]) -> None:
        """End the outermost open element of ``tags`` above the nearest of ``stop``."""
        if not any(self._open[t] for t in tags):
            return
        last = None
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag in tags:
                last = k
                if len(tags) == 1:
                    break
            elif tag in stop or tag in ("div", "table", "article", "section", "body"):
                break
        while last is not None and len(self._stack) > last:
            self._pop()

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body", "head"):
            if tag == "body" and self.body == 0:
                while len(self._stack) > 1:
                    self._pop()
            elif tag != "head" or len(self.tag) > 1:
                return
        elif self._open["head"] and tag not in IN_HEAD:
            self._pop_to({"head"}, set())
        if tag in BLOCK and self._open["p"]:
            self._pop_to({"p"}, {"button", "td", "th"})
        if tag in HEADING and self.tag[self._stack[-1]] in HEADING:
            self._pop()
        if tag in _IMPLIED:
            self._pop_to(*_IMPLIED[tag])
        if tag in BLOCK:
            self.events.append((self._stack[-1], None))
        elif tag == "br" or tag in CELL:
            self.events.append((self._stack[-1], " "))
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.named.append(tag not in ("article", "main", "body") and _named(tag, attributes))
        self.sign.append((tag, attributes.get("class", "")))
        if tag == "body":
            self.body = len(self.tag) - 1
        if tag not in VOID:
            self._stack.append(len(self.tag) - 1)
            self._open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or not self._open[tag]:
            if tag in BLOCK:
                self.events.append((self._stack[-1], None))
            return
        if tag not in BLOCK and tag not in CELL:
            for k in range(len(self._stack) - 1, 0, -1):
                if self.tag[self._stack[k]] == tag:
                    break
                if self.tag[self._stack[k]] in BLOCK:
                    return
        while self.tag[self._stack[-1]] != tag:
            self._pop()
        self._pop()

    def _text(self, text: str) -> None:
        if not text:
            return
        if self._open["head"]:
            if text.isspace():
                return
            self._pop_to({"head"}, set())
        self.events.append((self._stack[-1], _html.unescape(text)))

    def _parse(self, html: str) -> None:
        at = 0
        while True:
            m = _OPEN.search(html, at)
            if m is None:
                return self._text(html[at:])
            self._text(html[at: m.start()])
            if m[2] is None:
                end = html.find("-->" if m[3] else ">", m.start() + 2 if m[3] else m.end())
                if end < 0:
                    return None
                at = end + (3 if m[3] else 1)
                continue
            tag, rest = m[2].lower(), _attributes(html, m.end())
            if rest is None:
                return None
            attributes, at = rest
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                if end is None:
                    return None
                at = end.start()


def _cut(page: Page) -> list[bool]:
    """Of each node, whether it lies in a part that is no article."""
    n, holds, in_article = len(page.tag), [False] * len(page.tag), [False] * len(page.tag)
    for k in range(n - 1, 0, -1):
        if holds[k] or page.tag[k] in ("article", "main", "h1"):
            holds[page.parent[k]] = True
    cut = [False] * n
    for k in range(1, n):
        up, tag = page.parent[k], page.tag[k]
        in_article[k] = in_article[up] or tag in ("article", "main")
        cut[k] = cut[up] or tag in CUT_TAGS or page.named[k] and not holds[k]
        if tag == "header" and not in_article[k]:
            cut[k] = True
    # of a header inside an article only its headings are article
    for k in range(1, n):
        if not cut[k] and page.tag[page.parent[k]] == "header" and page.tag[k] not in HEADING and page.tag[k] not in ("hgroup", "div"):
            cut[k] = True
        cut[k] = cut[k] or cut[page.parent[k]]
    return cut


def densities(page: Page, cut: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Density of each node, sum over its children, its characters and those in links."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for k in range(1, n):
        linked[k] = linked[page.parent[k]] or page.tag[k] == "a"
    for node, text in page.events:
        if text and not cut[node]:
            c = len("".join(text.split()))
            chars[node] += c
            link_chars[node] += c if linked[node] else 0
    for k in range(n - 1, 0, -1):
        if not cut[k]:
            up = page.parent[k]
            tags[up] += tags[k] + 1
            link_tags[up] += link_tags[k] + (page.tag[k] == "a")
            chars[up] += chars[k]
            link_chars[up] += link_chars[k]
    share = link_chars[page.body] / max(chars[page.body], 1)
    density, total = [0.0] * n, [0.0] * n
    for k in range(n):
        c, t, lc, lt = chars[k], max(tags[k], 1), link_chars[k], max(link_tags[k], 1)
        if c and not cut[k]:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[k] = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0) + 1.0) / math.log(max(base, 1.0) + 1.0)
    for k in range(1, n):
        total[page.parent[k]] += density[k]
    return density, total, chars, link_chars


def select(page: Page) -> tuple[list[bool], list[bool]]:
    """Of each node, whether it belongs to the main text, and whether it is cut off."""
    n, cut = len(page.tag), _cut(page)
    density, total, chars, link_chars = densities(page, cut)
    inside = [False] * n
    inside[page.body] = True
    for k in range(1, n):
        inside[k] = inside[k] or inside[page.parent[k]]
    usable = [k for k in range(n) if inside[k] and not cut[k] and chars[k]]
    chosen = [False] * n
    if not usable:
        return chosen, cut
    heart = max(usable, key=lambda k: (total[k], -k))
    # article elements that are not inside another; main only where there is none
    for kind in ("article", "main"):
        outer, own = {}, [-1] * n
        for k in range(1, n):
            own[k] = own[page.parent[k]] if own[page.parent[k]] >= 0 else k if page.tag[k] == kind else -1
            if own[k] == k and not cut[k] and chars[k]:
                outer[k] = 0.0
        for k in usable:
            if own[k] in outer:
                outer[own[k]] = max(outer[own[k]], total[k])
        if outer:
            heart = own[heart] if own[heart] in outer else max(outer, key=lambda k: (outer[k], chars[k], -k))
            break
    named = page.tag[heart] in ("article", "main")
    threshold, k = density[heart], heart
    while k not in (page.body, 0):
        threshold, k = min(threshold, density[k]), page.parent[k]
    chosen[heart] = True
    for k in usable:
        if page.sign[k] == page.sign[heart] and density[k] >= threshold:
            chosen[k] = True
    for k in range(1, n):
        chosen[k] = chosen[k] or chosen[page.parent[k]]
        if chosen[k] and not named and k != heart and page.tag[k] in BLOCK - HEADING - {"p", "li"} and density[k] < threshold and 2 * link_chars[k] > chars[k]:
            cut[k] = True
        cut[k] = cut[k] or cut[page.parent[k]]
    return chosen, cut


def main_text(html: str | None) -> str:
    """Blocks of the main text joined by one line feed, white space inside a block one space; '' for null, empty and textless pages."""
    if not html:
        return ""
    page = Page(html)
    chosen, cut = select(page)
    blocks, held = [], []
    for node, text in [*page.events, (0, None)]:
        if text is None:
            block = " ".join("".join(held).split())
            held = []
            if block:
                blocks.append(block)
        elif chosen[node] and not cut[node]:
            held.append(text)
    return "\n".join(blocks)


#: Pages of an Arrow batch that become Python strings together.
SLICE = 64


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text of the whole page and its code points.

    A null or empty page and one without text give '' and 0; rows are answered one by
    one, also where ids repeat or are null; other columns of any name are left aside.
    An empty table gives no rows.  A page that ends inside a tag, comment or script is
    read up to there, as browsers do.
    """
    ship(pages.sparkSession)
    kinds = [pages.select(c).dtypes[0][1] for c in (key, url)]

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                part = whole.slice(s, SLICE)
                text = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                                      ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return chosen.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
