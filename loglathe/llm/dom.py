"""HTML to a flat tree of elements with numeric features, for a batch of pages at a time."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from html import unescape

import numpy as np

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_SPECIAL = re.compile(r"[>\"']")
#: Characters of a tag looked at by one pattern; where one is longer, that page's tags are followed from quote to quote.
TAG_CHARS = 200
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_TARGET = re.compile(r"data-y=(\d)")

#: Element names by role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = RAW | {"head", "noscript", "template", "select", "button", "svg", "canvas", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "img", "br", "input", "map", "object", "audio", "video", "picture",
    "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose",
    "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mtable", "mtr", "mtd", "semantics", "annotation",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
} | HEADINGS
#: What a start tag ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Blocks whose end tags end a cell.
CELL_ENDS = {"tr", "table", "tbody", "thead", "body", "html"}
TAG_GROUPS = (
    {"article", "main"}, {"section"}, {"div", "td", "body"}, {"p", "blockquote", "pre"}, HEADINGS, {"nav", "menu"}, {"header"},
    {"footer", "address"}, {"aside", "dialog"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"form", "fieldset", "label", "input", "legend"},
    {"table", "tr", "tbody"}, {"a"}, {"figure", "figcaption"}, INLINE - {"a", "label", "input"},
)
TOKEN_GROUPS = (
    {"article", "post", "entry", "story", "news", "blog"}, {"content", "main", "body", "text", "prose"},
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "skip"},
    {"header", "masthead", "top", "topbar", "branding", "logo"}, {"footer", "bottom", "copyright", "colophon", "contentinfo", "legal"},
    {"sidebar", "aside", "side", "rail", "widget", "complementary", "secondary"},
    {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "doubleclick"},
    {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "warning", "popup", "modal", "overlay", "message", "notification"},
    {"comment", "comments", "reply", "replies", "disqus", "respond", "discussion", "reader", "feedback"},
    {"share", "social", "related", "recommended", "more", "popular", "tags", "trending", "read", "also"},
    {"form", "search", "login", "signup", "subscribe", "newsletter", "subscription", "contact", "register"},
)
_TAG_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_TOKEN_GROUP = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g}
NO_GROUP = len(TAG_GROUPS)


class Markup:
    """Finds the tags of a page, each in time that does not grow with what follows it.

    A tag ends at the first ``>`` outside quotes or, where a quote stays open, at the first of all; without one it is text.
    """

    def __init__(self, html: str):
        self.html, self.end, self.last = html, len(html), html.rfind(">")
        self.ends: dict[int, int] = {}
        self.places: dict[str, list[int]] | None = None

    def _after(self, char: str, at: int) -> int:
        """The first place of a quote, or of any special character, from ``at`` on; -1 if there is none."""
        if self.places is None:
            found = [(m.start(), m[0]) for m in _SPECIAL.finditer(self.html)]
            self.places = {"": [p for p, _ in found]} | {c: [p for p, x in found if x == c] for c in "'\""}
        places = self.places[char]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def _quoted_end(self, at: int) -> int:
        """The ``>`` outside quotes, or -1; each place from which it was looked for is remembered."""
        passed = []
        while at not in self.ends:
            passed.append(at)
            special = self._after("", at)
            if special < 0 or self.html[special] == ">":
                self.ends[at] = special
                break
            closing = self._after(self.html[special], special + 1)
            if closing < 0:
                self.ends[at] = -1
                break
            at = closing + 1
        found = self.ends[at]
        for p in passed:
            self.ends[p] = found
        return found

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, behind, name, whether it ends an element, attributes) of the next markup; the name of a comment is empty."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            sign = html[at + 1 : at + 2]
            if sign in ("!", "?") and sign:
                if html.startswith("<!--", at):
                    close = html.find("-->", at + 4)
                    return at, self.end if close < 0 else close + 3, "", False, ""
                close = html.find(">", at + 2) if at < self.last else -1
                return at, self.end if close < 0 else close + 1, "", False, ""
            closing = sign == "/"
            if at < self.last and (m := _NAME.match(html, at + 1 + closing)):
                behind = m.end()
                if closing:
                    gt = html.find(">", behind)
                elif self.places is None and (got := _ATTRS.match(html, behind, min(self.end, behind + TAG_CHARS))):
                    gt = got.end() - 1
                elif (gt := self._quoted_end(behind)) < 0:
                    gt = html.find(">", behind)
                if gt >= 0:
                    return at, gt + 1, m[0].lower(), closing, html[behind:gt]
            at += 1
        return None


class Pages:
    """Elements of many pages; element 0 of each page is a root that holds the whole page."""

    def __init__(self) -> None:
        self.page: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.group: list[int] = []
        self.marks: list[int] = []
        self.target: list[int] = []
        self.roots: list[int] = []
        #: (element, block, text) of each piece of visible text, in page order; one list a page
        self.pieces: list[list[tuple[int, int, str]]] = []

    def _add(self, page: int, parent: int, depth: int, name: str, attrs: str) -> int:
        marks = 0
        if attrs and "=" in attrs:
            for value in _NAMES.findall(attrs):
                for token in _WORD.findall(value):
                    g = _TOKEN_GROUP.get(token.lower())
                    if g is not None:
                        marks |= 1 << g
            y = _TARGET.search(attrs)
            self.target.append(int(y[1]) if y else -1)
        else:
            self.target.append(-1)
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(depth)
        self.group.append(_TAG_GROUP.get(name, NO_GROUP))
        self.marks.append(marks)
        return len(self.page) - 1

    def parse(self, html: str, own: int = -1) -> None:
        """Adds a page; ``own``: the label of text that lies in no element, if it is known."""
        page = len(self.roots)
        root = self._add(page, -1, 0, "", "")
        self.target[root] = own
        self.roots.append(root)
        pieces: list[tuple[int, int, str]] = []
        self.pieces.append(pieces)
        names, nodes = [""], [root]
        # places in the stack of every open name, and of all that are not inline, so that no stack is searched
        places: dict[str, list[int]] = defaultdict(list)
        solid = [0]
        hidden = block = at = 0  # hidden: the depth of the stack from which nothing is seen
        end = len(html)

        def text(upto: int) -> None:
            if upto > at and not hidden:
                pieces.append((nodes[-1], block, html[at:upto]))

        def pop(to: int) -> None:
            nonlocal hidden
            for gone in names[to:]:
                places[gone].pop()
            del names[to:], nodes[to:]
            while solid[-1] >= to:
                solid.pop()
            if hidden and to <= hidden:
                hidden = 0

        def push(name: str, node: int) -> None:
            places[name].append(len(names))
            if name not in INLINE:
                solid.append(len(names))
            names.append(name)
            nodes.append(node)

        def innermost(of) -> int:
            return max((places[name][-1] for name in of if places[name]), default=0)

        markup = Markup(html)
        while at < end:
            m = markup.next(at)
            if m is None:
                text(end)
                break
            start, behind, name, closing, attrs = m
            text(start)
            at = behind
            if not name:
                continue
            if closing:
                if name not in INLINE:
                    block += 1
                # an inline end tag does not end blocks, nor a block's end tag a cell
                before = solid[-1] if name in INLINE else 0 if name in CELL_ENDS else innermost(("td", "th"))
                k = innermost((name,))
                if k and k >= before:
                    pop(k)
                continue
            if name not in INLINE:
                block += 1
            elif name == "br" and not hidden:
                pieces.append((nodes[-1], block, " "))
            if name in CLOSES_P and names[solid[-1]] == "p":
                pop(solid[-1])
            if name in ENDS:
                ended, stops = ENDS[name]
                k = innermost(ended)
                if k > innermost(stops):
                    pop(k)
            if name in VOID:
                if name == "input":
                    self._add(page, nodes[-1], len(nodes), name, attrs)
                continue
            if name in RAW:
                close = re.compile(f"</{name}", re.I).search(html, at)
                at = close.start() if close else end
                push(name, nodes[-1])
                hidden = hidden or len(names) - 1
                continue
            if attrs.endswith("/") and name in ("svg", "path"):
                continue
            node = self._add(page, nodes[-1], self.depth[nodes[-1]] + 1, name, attrs)
            push(name, node)
            if name in HIDDEN and not hidden:
                hidden = len(names) - 1

    def levels(self) -> list[np.ndarray]:
        depth = np.array(self.depth)
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []

    def features(self) -> np.ndarray:
        """A row an element: subtree density, attribute tokens, depth and sibling statistics, own and inherited."""
        n = len(self.page)
        parent, group, marks = np.array(self.parent), np.array(self.group), np.array(self.marks)
        page = np.array(self.page)
        own = np.zeros((n, 5))  # text, words, sentence marks, link text, pieces
        for pieces in self.pieces:
            for node, _, raw in pieces:
                size = len(raw)
                if size > 1 or not raw.isspace():
                    row = own[node]
                    row[0] += size
                    row[1] += raw.count(" ") + 1
                    row[2] += raw.count(".") + raw.count(",") + raw.count("?") + raw.count("!")
                    row[4] += 1
        links = group == 13
        own[links, 3] = own[links, 0]
        sub = np.column_stack([own, np.ones(n), group == 3, group == 10, group == 11, links])
        levels = self.levels()
        for level in reversed(levels[1:]):
            np.add.at(sub, parent[level], sub[level])
        # a bit a tag group, then a bit a token group
        bits = (1 << group.astype(np.int64)) | (marks.astype(np.int64) << (NO_GROUP + 1))
        above = np.zeros(n, np.int64)
        for level in levels[1:]:
            above[level] = above[parent[level]] | bits[parent[level]]
        index, siblings = np.zeros(n), np.ones(n)
        if n:
            by = np.lexsort((np.arange(n), parent))
            new = np.r_[True, parent[by][1:] != parent[by][:-1]]
            start = np.flatnonzero(new)
            counts = np.diff(np.r_[start, n])
            index[by] = np.arange(n) - np.repeat(start, counts)
            siblings[by] = np.repeat(counts, counts)
        roots = np.array(self.roots, np.int64)
        index[roots], siblings[roots] = 0, 1  # the roots of a batch are no siblings
        whole = np.maximum(sub[roots][page, 0], 1)
        up = np.maximum(sub[np.maximum(parent, 0), 0], 1)
        text = sub[:, 0]
        # where in the page's text an element begins
        seen = np.cumsum(own[:, 0]) - own[:, 0]
        place = (seen - seen[roots][page]) / whole
        nbits = NO_GROUP + 1 + len(TOKEN_GROUPS)
        flags = (bits[:, None] >> np.arange(nbits)) & 1
        inherited = (above[:, None] >> np.arange(nbits)) & 1
        return np.column_stack([
            flags, inherited, np.array(self.depth), np.log1p(text), np.log1p(own[:, 0]), sub[:, 3] / np.maximum(text, 1),
            text / sub[:, 5], sub[:, 2] / np.maximum(sub[:, 1], 1), sub[:, 1] / np.maximum(sub[:, 4], 1), text / whole, text / up,
            np.log1p(sub[:, 5]), sub[:, 6] / sub[:, 5], sub[:, 7] / sub[:, 5], sub[:, 8] / sub[:, 5], sub[:, 9] / sub[:, 5],
            index, siblings, index / siblings, place, np.log1p(sub[:, 6]),
        ]).astype(np.float32)

    def texts(self, chosen: np.ndarray) -> list[str]:
        """Blocks of the chosen elements' own text in page order."""
        out = []
        for pieces in self.pieces:
            blocks: list[list[str]] = []
            last = None
            for node, block, raw in pieces:
                if chosen[node]:
                    if block != last:
                        blocks.append([])
                        last = block
                    blocks[-1].append(raw)
            lines = (" ".join("".join(map(unescape, b)).split()) for b in blocks)
            out.append("\n".join(x for x in lines if x))
        return out
