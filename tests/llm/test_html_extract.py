from __future__ import annotations

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyman.llm import block_labeller, html_extract
from tallyman.llm.html_blocks import leaves
from tallyman.llm.queries import QUERIES


def lines(page):
    return [leaf.text for leaf in leaves(page)]


@pytest.fixture(scope="module")
def labeller(spark, sf_dir):
    return html_extract.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_leaf_blocks():
    assert lines("<p>a <b>b</b>c<p>d&amp;e &lt;p&gt; &copy &#x41;</p>f<br>g") == ["a bc", "d&e <p> © A", "f g"]
    assert lines("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert lines("<title>t</title><script>var a = '</p>';</script><style>p{}</style>x<!-- <p>no</p> -->y<textarea><p>z</textarea>") == ["xy"]
    assert lines("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert lines("a < b <3 </ > <p title='>'>c</p></div></span>d") == ["a < b <3", "c", "d"]
    assert lines("<script>never closed") == lines("<!-- never closed") == lines("") == lines(" \n<p> </p>") == []
    assert lines("<svg><text>x</text></svg><noscript>n</noscript>z<a href='x") == ["z"]
    assert lines("x  \t\n y<P CLASS=q>z") == ["x y", "z"]


def test_paths_and_links():
    found = list(leaves('<body><div class="mainMenu top-bar"><ul><li><a href="/">home page</a></ul></div><p>t <a>k</a>'))
    assert {"<div", ".main", ".menu", ".top", ".bar", "<li", "<a"} - {"<a"} <= found[0].path and found[0].linked == 9
    assert found[0].own == "li ul" and found[1].path == {"<body", "<p"} and found[1].linked == 1


def test_given_pages_give_their_articles(spark, sf_dir):
    """The markup of the given pages says what the article is; the labeller is held against it."""

    def article(page):
        body = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", body)]
        return "\n".join(p for p in parts if p)

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = QUERIES["op13_html_extract"](spark, sf_dir).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r["text"], r["url"]) == (article(pages[r["page_id"]]["html"]), pages[r["page_id"]]["url"])
        assert r["n_chars"] == len(r["text"])


PAGE = """<html><body><div id="cookie-banner">We use cookies. <button>Accept</button></div>
<div class="site-header"><div class="logo">The Daily Paper</div><div class="menu"><a href="/">Home</a><a href="/s">Sport</a></div></div>
<div class="container"><div class="{name}"><h1>Rain is expected in the north</h1><p>It will rain on Tuesday, the office said, and the
wind will turn to the west before the evening.</p><div class="ad">Buy two umbrellas and pay for one.</div><h2>What to do</h2><ul><li>Take a coat
with you.</li><li>Close the windows.</li></ul><p>The roads may be closed until the river has fallen again.</p></div>
<div class="comments"><h3>2 comments</h3><div class="comment"><p>ann</p><p>I do not believe that it will rain at all.</p></div></div>
<div class="sidebar"><p>Other stories you may like to read today.</p></div></div>
<form><label>Your address</label><input></form><div id="footer">Copyright, all rights reserved.</div></body></html>"""


@pytest.mark.parametrize("name", ["entry-content", "article-body", "post"])
def test_other_layouts(labeller, name):
    assert html_extract.main_texts([PAGE.replace("{name}", name)], labeller)[0].split("\n") == [
        "Rain is expected in the north",
        "It will rain on Tuesday, the office said, and the wind will turn to the west before the evening.",
        "What to do", "Take a coat with you.", "Close the windows.", "The roads may be closed until the river has fallen again.",
    ]


def test_layouts_it_has_not_seen(labeller):
    drawn = html_extract._Layouts(["some words that make up a line of text for the test"] * 3, 4321)
    pages = [p for p in (drawn.drawn() for _ in range(60)) if p[0]]
    likely = labeller.probabilities(block_labeller.blocks_of([p for p, _ in pages])) >= 0.5
    assert (likely == np.concatenate([m for _, m in pages])).mean() > 0.98


def test_odd_rows(spark, labeller):
    long = "<article>" + "<p>One paragraph of the story goes here.</p>" * 30000 + "</article>"
    text = "<body><article><p>The same story is told here twice.</p></article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a>Home</a></nav>"), (None, "u", text), (5, "a", text), (5, "a", text), (6, "u", long)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    data = spark.createDataFrame([(*r, "t", 1) for r in rows], schema)
    found = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_extract.extract(data, labeller).collect()))
    story = "The same story is told here twice."
    assert found[:6] == [(0, story, 34), (1, "", 0), (2, "", 0), (3, "", 0), (5, story, 34), (5, story, 34)]
    assert found[6][1].count("\n") == 29999
    assert html_extract.extract(data.limit(0), labeller).count() == 0


def test_learning_without_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_texts(["<article><p>A short story is told in these words.</p></article>"], html_extract.fit(none)) == [
        "A short story is told in these words."
    ]


def plain(labeller, blocks):
    """Each page on its own, block by block."""
    w, x, low, found = labeller.w, labeller.vectors(blocks), 0, []
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for size in blocks.sizes:
        page, low = x[low : low + size], low + size
        states = {}
        for way, order in (("ahead", range(size)), ("back", range(size - 1, -1, -1))):
            h = c = np.zeros(block_labeller.STATE)
            for n in order:
                i, f, o, new = np.split(page[n] @ w[way + "_in"] + h @ w[way + "_state"] + w[way + "_bias"], 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(new)
                h = sigmoid(o) * np.tanh(c)
                states[way, n] = h
        found += [sigmoid(np.concatenate([states["ahead", n], states["back", n], page[n]]) @ w["out"] + w["out_bias"])[0] for n in range(size)]
    return np.array(found)


def test_packed_states_equal_a_plain_loop():
    drawn = html_extract._Layouts(["a few words of text to draw from"], 1)
    blocks = block_labeller.blocks_of([drawn.drawn()[0] for _ in range(9)] + [[]])
    labeller = block_labeller.Labeller(3)
    assert np.allclose(labeller.probabilities(blocks), plain(labeller, blocks), atol=1e-5)


def test_slopes_equal_differences():
    drawn = html_extract._Layouts(["a few words of text to draw from"], 1)
    pages = [drawn.drawn() for _ in range(4)]
    blocks, marks = block_labeller.blocks_of([p for p, _ in pages]), np.concatenate([m for _, m in pages])
    labeller = block_labeller.Labeller(3)
    labeller.w = {k: v.astype(float) for k, v in labeller.w.items()}
    unseen = np.zeros(len(marks), bool)
    _, slopes = labeller.slopes(blocks, marks, unseen)
    for name, slope in slopes.items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        sides = []
        for step in (2e-2, -2e-2):
            labeller.w[name][at] += step
            sides.append(labeller.slopes(blocks, marks, unseen)[0])
            labeller.w[name][at] -= step
        assert slope[at] == pytest.approx((sides[0] - sides[1]) / 4e-2, rel=0.05, abs=1e-5), name


def test_learning_is_repeatable(spark, sf_dir):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy(F.col("page_id")).limit(20).collect()]
    one, other = (html_extract.learn(pages, layouts=20) for _ in range(2))
    assert all(np.array_equal(one.w[k], other.w[k]) for k in one.w)
