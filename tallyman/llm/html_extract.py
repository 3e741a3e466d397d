"""Main text of web pages by a recurrent block labeller.

Each page is read into its leaf blocks (``html_blocks``), each block is labelled with the whole page in view
(``block_labeller``), and the blocks labelled as main text are the result.

The labeller is trained here, on two kinds of pages. From a bounded sample of the given pages it takes those with an
``article`` or ``main`` element, whose markup marks the blocks. Pages without such markup have the same parts under other
names, so the sample's texts are also set into ``LAYOUTS`` drawn page layouts: articles in plain ``div`` elements with
usual class names, among menus, notices, adverts, sidebars, forms, reader comments and footers. Without any page, the
layouts are filled with made-up words.

Definitions: a null page is empty and has an empty text. Scripts, styles, the head and hidden elements are never text.
Character references are decoded once, white space inside a block (``br`` included) becomes one space, blocks are joined
by ``\\n``. Each row is judged alone, so repeated rows and ids get equal results. Other columns are ignored. The sample
(``max_training_pages``, each of at most ``MAX_TRAINING_BYTES``) only fits the labeller; every page is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_labeller import Labeller, blocks_of, train
from .html_blocks import Leaf, leaves
from .tokens import release_memory

MAX_TRAINING_PAGES = 200
MAX_TRAINING_BYTES = 1 << 15
LAYOUTS = 500
BLOCKS_AT_ONCE = 1 << 14

# Usual class names of a page's parts.
ARTICLE_NAMES = "article-body entry-content post-content article-content story-body content main-content post article entry story page-content body-text hentry single-post".split()
WRAPPER_NAMES = "container wrapper row col-8 inner site page-wrap grid section block box layout column region outer".split()
MENU_NAMES = "menu navbar nav main-nav topnav breadcrumb breadcrumbs toc pagination pager skip-links dropdown".split()
SIDE_NAMES = "sidebar side-column widget right-rail related related-posts recommended more-stories popular tags trending teaser".split()
AD_NAMES = "ad ads advert advertisement banner-ad sponsored promo ad-slot promotion adsbox sponsor commercial".split()
NOTICE_NAMES = "cookie cookie-banner consent notice alert gdpr popup modal overlay paywall subscribe newsletter disclaimer".split()
COMMENT_NAMES = "comments comment-list comment replies discussion responses reader-comments comment-thread".split()
FOOTER_NAMES = "footer site-footer bottom copyright legal colophon page-footer imprint".split()
HEADER_NAMES = "header site-header masthead top-bar branding banner logo page-header".split()
FORM_NAMES = "search-form login share social sharing signup contact-form feedback author-box byline meta".split()
_OTHER_PARTS = (MENU_NAMES, SIDE_NAMES, AD_NAMES, NOTICE_NAMES, COMMENT_NAMES, FOOTER_NAMES, HEADER_NAMES, FORM_NAMES)
_NOT_MAIN = {f".{w}" for names in _OTHER_PARTS for n in names for w in n.split("-")} - {
    f".{w}" for n in ARTICLE_NAMES + WRAPPER_NAMES for w in n.split("-")
} | {"<nav", "<footer", "<aside", "<form", "<menu", "<dialog", "<button", "@navigation", "@banner", "@contentinfo", "@complementary", "@search"}
_MAIN = {"<article", "<main", "@main", "@article"}
_PHRASES = (
    "Accept all cookies|We use cookies to improve this site|Subscribe to our newsletter|All rights reserved|© 2024|Share|Read more|"
    "Log in|Search|Leave a reply|3 comments|Reply|Advertisement|Sponsored|Related articles|Follow us|Privacy policy|Home|Contact|Menu"
).split("|")
_YES, _NO = "", ""  # marks in front of drawn texts


def marked(page: str) -> tuple[list[Leaf], np.ndarray] | None:
    """A page's blocks and whether its own markup says that they are main text; None without such markup."""
    found = list(leaves(page))
    if not any(leaf.path & _MAIN for leaf in found):
        return None

    def main(leaf: Leaf) -> bool:
        if not leaf.path & _MAIN or leaf.path & _NOT_MAIN:
            return False
        return "<header" not in leaf.path or leaf.own[:1] == "h" and leaf.own[1:2].isdigit()

    return found, np.array([main(leaf) for leaf in found], bool)


class _Layouts:
    """Draws pages in which each block's text begins with its mark."""

    def __init__(self, texts: list[str], seed: int):
        self.draw = np.random.default_rng(seed)
        self.texts = texts

    def chance(self, share: float) -> bool:
        return bool(self.draw.random() < share)

    def one(self, values):
        return values[int(self.draw.integers(len(values)))]

    def some(self, low: int, high: int) -> range:
        return range(int(self.draw.integers(low, high + 1)))

    def words(self, low: int, high: int) -> str:
        source = self.one(self.texts).split()
        size = int(self.draw.integers(low, high + 1))
        at = int(self.draw.integers(max(1, len(source) - size + 1)))
        return " ".join(source[at : at + size]).replace("&", "&amp;").replace("<", "&lt;") or "text"

    def sentence(self, low: int = 6, high: int = 60) -> str:
        return self.words(low, high) + self.one([".", ".", ".", "", "!", "?"])

    def short(self) -> str:
        return self.one(_PHRASES) if self.chance(0.3) else self.words(1, 6)

    def tag(self, names: list[str], element: str | None, share: float) -> tuple[str, str]:
        """Start and end of a part: its own element, or another with one of the usual names."""
        kind = element if element and self.chance(share) else self.one(["div", "div", "section"])
        if kind == element and self.chance(0.6):
            return f"<{kind}>", f"</{kind}>"
        name = self.one(names) + (" " + self.one(WRAPPER_NAMES) if self.chance(0.2) else "")
        return f'<{kind} {self.one(["class", "class", "id"])}="{name}">', f"</{kind}>"

    def inline(self, text: str) -> str:
        words = text.split()
        if len(words) > 3 and self.chance(0.25):
            at, element = int(self.draw.integers(len(words))), self.one(["b", "i", "em", "strong", "span", 'a href="/x"'])
            words[at] = f"<{element}>{words[at]}</{element.split()[0]}>"
        return " ".join(words)

    def links(self) -> str:
        items = [f'<a href="/{n}">{_NO}{self.short()}</a>' for n in self.some(2, 8)]
        if self.chance(0.6):
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        if self.chance(0.5):
            return "".join(f"<p>{i}</p>" for i in items)
        return _NO + " ".join(items).replace(_NO, "")

    def part(self, names: list[str], element: str | None, share: float = 0.5) -> str:
        start, end = self.tag(names, element, share)
        inner = []
        for _ in self.some(1, 3):
            what = self.draw.random()
            if what < 0.35:
                inner.append(self.links())
            elif what < 0.75:
                inner.append(f"<p>{_NO}{self.inline(self.sentence(1, 30))}</p>" if self.chance(0.6) else f"<div>{_NO}{self.sentence(1, 30)}</div>")
            elif what < 0.9:
                inner.append(f"<h{self.draw.integers(2, 5)}>{_NO}{self.short()}</h3>")
            else:
                inner.append(f"<span>{_NO}{self.short()}</span><br>")
        if self.chance(0.3):
            inner = [_NO + self.sentence(2, 20)]
        return start + "".join(inner) + end

    def comments(self) -> str:
        start, end = self.tag(COMMENT_NAMES, None, 0)
        element = self.one(["div", "li", "article", "section"])
        each = "".join(
            f'<{element} class="{self.one(["comment", "reply", "comment-body", "response"])}"><p>{_NO}{self.short()}</p><p>{_NO}{self.sentence()}</p></{element}>'
            for _ in self.some(1, 5)
        )
        return f"{start}<h3>{_NO}{self.short()}</h3>{each}{end}"

    def form(self) -> str:
        inner = f"<label>{_NO}{self.short()}</label> <input name=q> <button>{self.short()}</button>"
        return f"<form>{inner}</form>" if self.chance(0.7) else f'<div class="{self.one(FORM_NAMES)}">{inner}</div>'

    def article(self) -> str:
        body = [f"<h1>{_YES}{self.words(2, 12)}</h1>"] if self.chance(0.9) else []
        for _ in self.some(1, 14):
            what = self.draw.random()
            if what < 0.72:
                open_ = self.chance(0.15)
                body.append(f"<p>{_YES}{self.inline(self.sentence(1, 90))}" + ("<br>" if open_ else "</p>"))
            elif what < 0.8:
                body.append(f"<h2>{_YES}{self.words(1, 8)}</h2>")
            elif what < 0.86:
                body.append("<ul>" + "".join(f"<li>{_YES}{self.sentence(2, 20)}</li>" for _ in self.some(1, 5)) + "</ul>")
            elif what < 0.9:
                body.append(f"<blockquote><p>{_YES}{self.sentence()}</p></blockquote>")
            elif what < 0.93:
                body.append(f"<table><tr><td>{_YES}{self.words(1, 5)}</td><td>{_YES}{self.words(1, 5)}</td></tr></table>")
            else:
                other = int(self.draw.integers(4))
                body.append(self.form() if other == 3 else self.part((AD_NAMES, SIDE_NAMES, FORM_NAMES)[other], (None, "aside", None)[other]))
        start, end = self.tag(ARTICLE_NAMES, self.one(["article", "main"]), 0.35)
        inside = self.comments() if self.chance(0.2) else ""
        return start + "".join(body) + inside + end

    def page(self) -> str:
        parts = []
        if self.chance(0.4):
            parts.append(self.part(NOTICE_NAMES, None))
        if self.chance(0.6):
            parts.append(self.part(HEADER_NAMES, "header"))
        if self.chance(0.7):
            parts.append(self.part(MENU_NAMES, "nav"))
        if self.chance(0.4):
            parts.append(self.part(AD_NAMES, None))
        if self.chance(0.25):
            parts.append(self.part(SIDE_NAMES, "aside"))
        middle = self.article()
        if self.chance(0.35):
            middle += self.comments()
        if self.chance(0.35):
            middle += self.part(SIDE_NAMES, "aside")
        if self.chance(0.2):
            middle += self.form()
        for _ in self.some(0, 2):
            middle = f'<div class="{self.one(WRAPPER_NAMES)}">{middle}</div>'
        parts.append(middle)
        if self.chance(0.2):
            parts.append(self.part(NOTICE_NAMES, None))
        if self.chance(0.7):
            parts.append(self.part(FOOTER_NAMES, "footer"))
        return "<html><head><title>x</title></head><body>" + "\n".join(parts) + "</body></html>"

    def drawn(self) -> tuple[list[Leaf], np.ndarray]:
        found = [leaf for leaf in leaves(self.page()) if leaf.text[0] in _YES + _NO]
        marks = np.array([leaf.text[0] == _YES for leaf in found], bool)
        clean = [leaf._replace(text=leaf.text.replace(_YES, "").replace(_NO, "").strip() or "x") for leaf in found]
        return clean, marks


def learn(pages: list[str], layouts: int = LAYOUTS, seed: int = 13) -> Labeller:
    """A labeller from sample pages and drawn layouts."""
    texts = [leaf.text for page in pages for leaf in leaves(page)]
    if not texts:
        draw = np.random.default_rng(seed)
        letters = [chr(97 + n) for n in range(26)]
        texts = [" ".join("".join(draw.choice(letters, draw.integers(1, 9))) for _ in range(40)) for _ in range(100)]
    drawn = _Layouts(texts, seed)
    examples = [m for m in map(marked, pages) if m is not None]
    return train(examples + [drawn.drawn() for _ in range(layouts)], seed=seed)


def fit(pages: DataFrame, max_training_pages: int = MAX_TRAINING_PAGES) -> Labeller:
    """Learn from the pages with the lowest hash; at most ``max_training_pages`` of ``MAX_TRAINING_BYTES`` each."""
    small = pages.filter(F.octet_length("html").between(1, MAX_TRAINING_BYTES)).select("html", F.xxhash64("html").alias("draw"))
    # The pages are drawn by their hashes; only those are read, and copies of one page count once.
    drawn = [r["draw"] for r in small.select("draw").distinct().orderBy("draw").limit(max_training_pages).collect()]
    rows = small.filter(F.col("draw").isin(drawn)).groupBy("draw").agg(F.min("html").alias("html")).orderBy("draw").collect()
    return learn([r["html"] for r in rows])


def main_texts(pages: list[str], labeller: Labeller) -> list[str]:
    """The main text of each page."""
    found: list[str] = []
    waiting: list[list[Leaf]] = []

    def label() -> None:
        likely = labeller.probabilities(blocks_of(waiting)) >= 0.5
        at = 0
        for blocks in waiting:
            found.append("\n".join(b.text for b, main in zip(blocks, likely[at : at + len(blocks)], strict=True) if main))
            at += len(blocks)
        waiting.clear()

    size = 0
    for page in pages:
        waiting.append(list(leaves(page)))
        size += len(waiting[-1])
        if size >= BLOCKS_AT_ONCE:
            label()
            size = 0
    label()
    return found


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller: Labeller = shared.value
        for batch in batches:
            texts = main_texts([p or "" for p in batch.column(2).to_pylist()], labeller)
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column(0),
                    "url": batch.column(1),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )
        release_memory()

    return run


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """Main text of each page: ``page_id``, ``url``, ``text``, ``n_chars``. The broadcast labeller has a fixed size."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)
    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return columns.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")
