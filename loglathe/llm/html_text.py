"""Main text of HTML pages: boosted trees over element features, then one consistent choice a tree.

Each element gets the probability that it belongs to the article.  A path from the root down is first
outside the article, then inside, then in something cut out of it (an advert, a comment list), and never
turns back; among all such labellings of a page the most likely one is taken, by dynamic programming over
the tree.  Text that lies in no element belongs to the page's root, which can be inside only where it has such text.
So no element is chosen inside a rejected part of an article, and no article is torn apart by
one doubtful paragraph.

The classifier is fitted on pages that ``training_page`` makes up: ``TRAINING_PAGES`` layouts of invented
words with known article elements, of a fixed seed.

Defined results: a null or empty page gives the empty text; equal rows give equal texts; an empty table an
empty result; broken markup is read as browsers do, roughly; other columns pass by ``carry`` only, and one named text gives way to the result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .boosting import Boosted
from .common import bound_arrow, empty_text, packed, unpacked
from .dom import Pages

TRAINING_PAGES = 1200
#: What each element costs in which the article begins, in units of log-odds: an article is one subtree, or few.
START = 2.0


class _Maker:
    """One made-up page."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.syllables = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouéäñ") for _ in range(r.randint(1, 2))) for _ in range(60)]
        self.hints = r.random() < 0.7  # do classes and ids tell anything?
        self.semantic = r.random() < 0.65  # are nav, article, footer used?
        self.noise = r.random() < 0.12

    def words(self, low: int, high: int) -> str:
        r, out, upper = self.r, [], True
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice(self.syllables) for _ in range(r.randint(1, 3)))
            if self.noise:
                w += r.choice(("***", "###", "&amp;&amp;&amp;", "%%%", "!!", " |"))
            w = w.capitalize() if upper else w
            upper = r.random() < 0.1
            out.append(w + ("." if upper else "," if r.random() < 0.05 else ""))
        return " ".join(out)

    def attr(self, *names: str) -> str:
        r = self.r
        if not self.hints:
            return r.choice(("", f' class="c{r.randint(1, 99)}"', ' class="row"', ' id="x1"'))
        name = r.choice(names)
        if r.random() < 0.3:
            name = r.choice(("left-", "main-", "site-", "page-", "box ")) + name
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def el(self, y: int, tag: str, inner: str, attrs: str = "", end: bool = True) -> str:
        return f"<{tag}{attrs} data-y={y}>{inner}" + (f"</{tag}>" if end else "")

    def links(self, y: int, low: int, high: int, text: tuple[int, int] = (1, 3)) -> str:
        r = self.r
        items = [self.el(y, "a", self.words(*text), f' href="/{r.randint(1, 999)}"') for _ in range(r.randint(low, high))]
        style = r.random()
        if style < 0.6:
            return self.el(y, "ul", "".join(self.el(y, "li", i) for i in items))
        return r.choice((" | ", " ", "\n")).join(items) if style < 0.8 else "".join(self.el(y, "div", i) for i in items)

    def menu(self) -> str:
        inner = self.links(0, 3, 9)
        return self.el(0, "nav", inner, self.r.choice(("", self.attr("menu")))) if self.semantic else self.el(0, "div", inner, self.attr("nav", "menu", "navbar", "navigation", "breadcrumbs"))

    def header(self) -> str:
        inner = self.el(0, self.r.choice(("h1", "div", "p")), self.words(1, 5)) + (self.el(0, "p", self.words(3, 10)) if self.r.random() < 0.4 else "")
        inner += self.menu() if self.r.random() < 0.4 else ""
        return self.el(0, "header", inner) if self.semantic else self.el(0, "div", inner, self.attr("header", "masthead", "top", "branding"))

    def footer(self) -> str:
        r = self.r
        inner = r.choice(("&copy; ", "Copyright ", "")) + self.words(2, 25) + (self.links(0, 2, 6) if r.random() < 0.4 else "")
        inner = self.el(0, "p", inner) if r.random() < 0.4 else inner
        return self.el(0, "footer", inner) if self.semantic or r.random() < 0.3 else self.el(0, "div", inner, self.attr("footer", "copyright", "bottom", "legal"))

    def advert(self) -> str:
        inner = self.words(3, 25)
        inner = self.el(0, "a", inner, ' href="/buy"') if self.r.random() < 0.3 else self.el(0, "p", inner) if self.r.random() < 0.3 else inner
        names = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")
        keep, self.hints = self.hints, self.hints or self.r.random() < 0.7
        out = self.el(0, self.r.choice(("div", "div", "aside", "section")), inner, self.attr(*names))
        self.hints = keep
        return out

    def notice(self) -> str:
        inner = self.el(0, self.r.choice(("p", "span", "div")), self.words(6, 30)) + self.r.choice(("", "<button>OK</button>"))
        return self.el(0, self.r.choice(("div", "div", "section", "dialog")), inner, self.attr("cookie-notice", "cookie", "notice", "consent", "alert", "popup", "modal") + self.r.choice(("", ' role="alert"')))

    def sidebar(self) -> str:
        r = self.r
        inner = self.el(0, r.choice(("h2", "h3")), self.words(1, 3)) + self.links(0, 3, 8, (2, 7))
        inner += self.el(0, "p", self.words(8, 40)) if r.random() < 0.4 else ""
        tag, attrs = ("aside", "") if self.semantic or r.random() < 0.2 else ("div", self.attr("sidebar", "side", "widget", "related", "rail", "popular"))
        return self.el(0, tag, inner, attrs)

    def form(self) -> str:
        r = self.r
        inner = "".join(self.el(0, "label", self.words(1, 4)) + f'<input name="f{k}">' for k in range(r.randint(1, 4)))
        inner += (self.el(0, "p", self.words(5, 20)) if r.random() < 0.5 else "") + "<button>Go</button>" + r.choice(("", "<textarea>x</textarea>"))
        return self.el(0, "form", inner, r.choice(("", self.attr("search", "signup", "newsletter", "contact", "login"))))

    def comments(self) -> str:
        r = self.r
        each = r.choice(("div", "li", "article", "p"))
        items = []
        for _ in range(r.randint(1, 6)):
            body = self.words(5, 60)
            if each != "p":
                body = self.el(0, r.choice(("b", "span", "cite", "h4")), self.words(1, 2)) + self.el(0, "p", body)
            items.append(self.el(0, each, body, self.attr("comment", "reply") if r.random() < 0.6 else ""))
        inner = (self.el(0, r.choice(("h2", "h3")), self.words(1, 3)) if r.random() < 0.6 else "") + ("".join(items) if each != "li" else self.el(0, r.choice(("ul", "ol")), "".join(items)))
        keep, self.hints = self.hints, True  # without any name, readers' and authors' paragraphs are alike
        out = self.el(0, r.choice(("section", "div", "div", "aside")), inner, self.attr("comments", "comments", "comment-list", "discussion", "reader-comments", "replies"))
        self.hints = keep
        return out

    def article(self) -> str:
        r = self.r
        parts = [self.el(1, r.choice(("h1", "h1", "h2")), self.words(2, 14))] if r.random() < 0.85 else []
        loose_end = r.random() < 0.2
        for k in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14))+ (not parts)):
            kind = r.random()
            body = self.words(1, 8) if r.random() < 0.15 else self.words(8, 120)
            if r.random() < 0.2:
                body += " " + self.el(1, r.choice(("b", "em", "i", "strong", "span", "code")), self.words(1, 4)) + " " + self.words(1, 10)
            if r.random() < 0.12:
                body += " " + self.el(1, "a", self.words(1, 3), ' href="/q"') + " " + self.words(1, 9)
            if kind < 0.78:
                if loose_end and r.random() < 0.5:
                    parts.append(f"<p data-y=1><b data-y=1>{body}<br>")
                else:
                    parts.append(self.el(1, "p", body, "", not (loose_end and r.random() < 0.5)))
            elif kind < 0.83:
                parts.append(self.el(1, r.choice(("h2", "h3")), self.words(1, 7)))
            elif kind < 0.88:
                parts.append(self.el(1, r.choice(("ul", "ol")), "".join(self.el(1, "li", self.words(2, 25)) for _ in range(r.randint(2, 5)))))
            elif kind < 0.91:
                parts.append(self.el(1, "blockquote", self.el(1, "p", body) if r.random() < 0.5 else body))
            elif kind < 0.94:
                parts.append(self.el(1, "figure", "<img src=x>" + self.el(1, "figcaption", self.words(3, 12))))
            elif kind < 0.96:
                rows = "".join(self.el(1, "tr", "".join(self.el(1, "td", self.words(1, 4)) for _ in range(3))) for _ in range(3))
                parts.append(self.el(1, "table", rows))
            else:
                parts.append(self.el(1, "div", body))
            if k and r.random() < 0.05:
                parts.append(r.choice((self.advert, self.sidebar, self.form, self.notice))())
        if r.random() < 0.12:
            parts.append(self.comments())
        if r.random() < 0.08:
            parts.append(self.el(0, "div", self.links(0, 2, 6), self.attr("share", "social", "tags", "related")))
        inner = "\n".join(parts) if r.random() < 0.5 else "".join(parts)
        if r.random() < 0.25:
            inner = self.el(1, "div", inner, self.attr("content", "body", "text", "entry-content"))
        if self.semantic or r.random() < 0.2:
            return self.el(1, r.choice(("article", "article", "article", "main")), inner, r.choice(("", "", self.attr("post", "story"))))
        return self.el(1, r.choice(("div", "div", "section", "td")), inner, self.attr("content", "article", "post", "entry", "main-content", "story"))

    def fragment(self) -> tuple[str, int]:
        r = self.r
        if r.random() < 0.7:
            parts = [self.words(8, 120) for _ in range(r.randint(1, 5))]
            body = r.choice(("<br><br>", "<br>", " <b data-y=1>x</b> ", "\n")).join(parts)
            around = [f() for f, p in ((self.menu, 0.2), (self.advert, 0.2), (self.footer, 0.2)) if r.random() < p]
            return (around[0] if around else "") + body + "".join(around[1:]), 1
        whole = self.page()
        return (self.words(1, 3) + whole, 0) if r.random() < 0.5 else (whole + self.words(1, 3), 0)

    def page(self) -> str:
        r = self.r
        before = [f for f, p in ((self.notice, 0.15), (self.header, 0.35), (self.menu, 0.8), (self.advert, 0.4), (self.sidebar, 0.2), (self.form, 0.1)) if r.random() < p]
        after = [f for f, p in ((self.sidebar, 0.2), (self.comments, 0.3), (self.advert, 0.2), (self.form, 0.15), (self.notice, 0.1), (self.footer, 0.85), (self.notice, 0.05)) if r.random() < p]
        if r.random() < 0.12:  # little or nothing besides the article
            before, after = before[: r.randint(0, 1)], after[: r.randint(0, 1)]
        middle = self.article()
        if r.random() < 0.25:
            extra = "".join(f() for f in r.sample((self.advert, self.sidebar, self.comments, self.form, self.menu), r.randint(0, 2)))
            middle = self.el(0, r.choice(("main", "div", "div", "section")), middle + extra if r.random() < 0.6 else extra + middle, r.choice(("", self.attr("main", "content", "page", "wrapper"))))
        body = "".join(f() for f in before) + middle + "".join(f() for f in after)
        if r.random() < 0.2:
            body = self.el(0, r.choice(("div", "div", "div", "form")), body, self.attr("page", "wrapper", "container"))
        for _ in range(r.choice((0, 0, 0, 0, 1, 2, 4, 8, 20))):  # depth alone says little
            body = self.el(0, "div", body, r.choice(("", "", self.attr("page", "wrapper", "container"))))
        return f"<!DOCTYPE html><html data-y=0><head data-y=0><title>{self.words(1, 9)}</title><style>p{{}}</style></head><body data-y=0>{body}</body></html>"


def training_page(seed: int) -> str:
    """A page whose elements say in ``data-y`` whether they belong to the article."""
    return _Maker(seed).page()


def training_fragment(seed: int) -> tuple[str, int]:
    """A piece of a page with text that lies in no element, and whether that text is the article."""
    return _Maker(seed).fragment()


@cache
def model(pages: int = TRAINING_PAGES, seed: int = 7) -> Boosted:
    made = Pages()
    for k in range(pages):
        made.parse(training_page(seed * 1_000_003 + k))
    for k in range(pages // 6):
        made.parse(*training_fragment(seed * 2_000_003 + k))
    known = np.array(made.target) >= 0
    return Boosted().fit(made.features()[known], np.array(made.target)[known].astype(float))


def decode(pages: Pages, odds: np.ndarray) -> np.ndarray:
    """The most likely labelling outside / inside / cut out along all paths; True where inside."""
    parent, levels = np.array(pages.parent), pages.levels()
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    gain = np.column_stack([no, yes, no])
    roots = np.array(pages.roots, np.int64)
    if len(roots):
        bare = np.zeros(len(parent), bool)  # elements with text of their own
        for pieces in pages.pieces:
            bare[[node for node, _, raw in pieces if not raw.isspace()]] = True
        closed = roots[~bare[roots]]  # a page's root can be chosen only for such text
        gain[closed] = [0, -np.inf, -np.inf]
        gain[roots, 2] = -np.inf
    for level in reversed(levels[1:]):
        g = gain[level]
        np.add.at(gain, parent[level], np.column_stack([np.maximum(g[:, 0], g[:, 1] - START), np.maximum(g[:, 1], g[:, 2]), g[:, 2]]))
    state = np.zeros(len(parent), np.int64)
    if len(roots):
        state[roots] = gain[roots, 1] > gain[roots, 0]
    for level in levels[1:]:
        up, g = state[parent[level]], gain[level]
        state[level] = np.where(up == 0, g[:, 1] - START > g[:, 0], np.where(up == 1, 1 + (g[:, 2] > g[:, 1]), 2))
    return state == 1


def extract(htmls: list[str], trees: Boosted) -> list[str]:
    pages = Pages()
    for html in htmls:
        pages.parse(html)
    return pages.texts(decode(pages, trees.log_odds(pages.features()))) if htmls else []


def main_text(df: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` columns and ``text`` of every row."""
    spark = df.sparkSession
    bound_arrow(spark)
    shared = spark.sparkContext.broadcast(model())  # of fixed size
    rows = df.select(packed(carry).alias("row"), empty_text(F.col(f"`{html}`")).alias("html"))
    schema = StructType([rows.schema["row"], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = extract(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return rows.mapInArrow(run, schema).select(*unpacked(carry, ("text",)))
