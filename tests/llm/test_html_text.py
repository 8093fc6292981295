"""HTML reading, the classifier on unseen made-up pages, decoding, and edge cases."""

import itertools
import time

import numpy as np
import pytest

from loglathe.llm import html_text
from loglathe.llm.dom import Pages


@pytest.fixture(scope="module")
def trees():
    return html_text.model()


def test_unseen_pages(trees):
    same = nodes = right = 0
    for k in range(150):
        pages = Pages()
        pages.parse(html_text.training_page(999_000_000 + k))
        want = np.array(pages.target)
        chosen = html_text.decode(pages, trees.log_odds(pages.features()))
        same += pages.texts(want == 1) == pages.texts(chosen)
        right += int((chosen == (want == 1))[want >= 0].sum())
        nodes += int((want >= 0).sum())
    assert right / nodes > 0.97 and same / 150 > 0.85


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">More</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to serve you.</p></div>
<article><h1>Headline&nbsp;of   the &lt;day&gt;</h1><p>First paragraph with <b>bold</b> and<br>a break, long enough to be prose.<p>Second one,
over two lines, &eacute;&#233;&#xe9; and a plain &amp ampersand.</p><!-- <p>hidden</p> -->
<div class="ad"><p>Buy it now, cheap, today.</p></div><p>Third paragraph, which also goes on for a while.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><b>Bob</b><p>I do not agree with any of this, sorry.</p></div></section>
<aside><h3>Related</h3><ul><li><a href="/x">Another thing</a></li></ul></aside><form><label>Mail</label><input name=m></form><footer>&copy; example. All rights reserved.</footer>"""


def test_page(trees):
    (got,) = html_text.extract([PAGE], trees)
    assert got == (
        "Headline of the <day>\nFirst paragraph with bold and a break, long enough to be prose.\n"
        "Second one, over two lines, ééé and a plain & ampersand.\nThird paragraph, which also goes on for a while."
    )


def test_deep_pages_and_bare_text(trees):
    deep = "<div>" * 250 + PAGE[PAGE.index("<article>") : PAGE.index("</article>") + 10] + "</div>" * 250
    assert "Buy it now" not in html_text.extract([deep], trees)[0] and "Third paragraph" in html_text.extract([deep], trees)[0]
    words = "A plain text without any element, which goes on for some words. And then it goes on for some more of them, and ends. " * 4
    words = words.strip()
    assert html_text.extract([words, words + "<br>" + words], trees) == [words, words + " " + words]
    pages = Pages()
    pages.parse("<span>" * 60_000 + "</i>" * 60_000 + "text")  # in time
    assert len(pages.page) == 60_001


HOSTILE = {
    "no tag ends": "<a" * 500_000, "no end tag ends": "</a" * 330_000, "attributes": "<a x" * 250_000, "open quotes": '<a "' * 250_000, "one end": "<a '" * 250_000 + ">",
    "ends in quotes": '<a ">"' * 166_000 + "'", "two quotes": "<a b='>' " * 110_000 + '"', "signs": "<" * 1_000_000, "comments": "<!--" * 250_000,
    "a cell between": "<p><td>" + "<b>" * 1000 + "<hr>" * 200_000, "end tags": "<i><td>" + "<b>" * 1000 + "</i>" * 200_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_markup_takes_time_in_proportion(name):
    began = time.process_time()
    Pages().parse(HOSTILE[name])
    assert time.process_time() - began < 4  # alone under 2 s each


def test_tags_of_any_length_and_quotes(trees):
    """A long tag, and those behind it, which are read from quote to quote, are the tags they are without it."""
    rest = PAGE + """<p title='a > b' class="x>y">Seen.</p><p title="open>Also seen.</p><p>And this, it's "quoted", goes on.</p>"""
    short, long = Pages(), Pages()
    short.parse('<div id="x">' + rest)
    long.parse('<div id="x" data-z="' + "z" * 5000 + '">' + rest)
    for k in ("parent", "group", "marks", "pieces"):
        assert getattr(short, k) == getattr(long, k)


def test_what_stands_in_a_line_stays(trees):
    """Formulas, maps and objects are part of their block; a reference cut by markup is none."""
    inside = "<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as is well known to all, and <map name=m>the map</map> or "
    inside += "<object>the object</object> with <video>no video</video> shows &am<b>p;</b> it.</p>"
    page = PAGE.replace("<article>", "<article>" + inside)
    assert "Energy is E=mc2 as is well known to all, and the map or the object with no video shows &amp; it.\n" in html_text.extract([page], trees)[0]


@pytest.mark.parametrize("seed", range(40))
def test_decoding_finds_the_best_labelling(seed):
    rng = np.random.default_rng(seed)
    html, open_ = "x" if seed % 2 else "", 0
    for _ in range(6):
        if open_ and rng.random() < 0.4:
            html, open_ = html + "</div>", open_ - 1
        html, open_ = html + "<div>t", open_ + 1
    pages = Pages()
    pages.parse(html)
    n, parent = len(pages.page), pages.parent
    odds = rng.normal(0, 2, n)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best, chosen = -np.inf, None
    for states in itertools.product((0, 1, 2), repeat=n):  # outside, inside, cut out
        if states[0] == 2 or states[0] == 1 and not html.startswith("x"):
            continue
        if any(states[parent[k]] > states[k] or (states[parent[k]], states[k]) == (0, 2) for k in range(1, n)):
            continue
        gain = sum(yes[k] if s == 1 else no[k] for k, s in enumerate(states))
        gain -= html_text.START * sum(states[k] == 1 and states[parent[k]] == 0 for k in range(1, n))
        if gain > best + 1e-12:
            best, chosen = gain, [s == 1 for s in states]
    assert html_text.decode(pages, odds).tolist() == chosen


def test_odd_pages(trees):
    odd = ["", "plain words", "<", "<p", "<p>a<", "</p></div>", "<script>never ends", "<!-- never ends", "<div>" * 3000 + "deep", "<a b='c>text", "&#0; &#xffffff;", "<p>" + "long " * 50_000, "<>", "< p>x"]
    assert len(html_text.extract(odd, trees)) == len(odd)
    assert html_text.extract(["", "<html></html>"], trees) == ["", ""]
    assert html_text.extract([], trees) == []


def test_decoding_never_turns_back(trees):
    rng = np.random.default_rng(5)
    for k in range(30):
        pages = Pages()
        pages.parse(html_text.training_page(k))
        chosen = html_text.decode(pages, rng.normal(0, 3, len(pages.page)))
        parent = pages.parent
        for node in range(len(chosen)):
            path = []
            while node >= 0:
                path.append(bool(chosen[node]))
                node = parent[node]
            # one run of chosen elements on any path
            assert sum(a != b for a, b in zip(path, path[1:], strict=False)) <= 2


def test_rows(spark, trees):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.main_text(df).collect()), key=str)
    (text,) = html_text.extract([PAGE], trees)
    assert got == sorted([(1, "u", text), (2, None, ""), (None, "u", ""), (1, "u", text)], key=str)
    assert html_text.main_text(df.limit(0)).count() == 0
