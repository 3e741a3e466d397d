"""HTML to its leaf blocks: runs of text between block boundaries, with the elements around them.

The reader follows the rules of browsers where they matter for text: raw text elements, character references without a
semicolon, end tags that may be left out, stray end tags, unclosed quotes and comments.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SILENT = frozenset("template svg math canvas audio video object select datalist noscript".split())
# An open element is closed by the start of one of these, unless one of the fences lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Leaf(NamedTuple):
    text: str  # one line
    path: frozenset[str]  # names of the elements around it, and the words of their classes and ids
    own: str  # the nearest block and the one around it
    linked: int  # characters inside links
    depth: int


def _labels(name: str, attributes: str) -> list[str]:
    found = ["<" + name]
    if "=" in attributes:
        for kind, *value in _NAMES.findall(attributes):
            words = _PART.findall("".join(value))
            found += [("@" if kind.lower() == "role" else ".") + w.lower() for w in words]
    return found


class _Reader:
    def __init__(self):
        self.stack: list[tuple[str, list[str]]] = []
        self.around: Counter[str] = Counter()
        self.open: Counter[str] = Counter()
        self.links = self.silent = 0
        self.parts: list[str] = []
        self.linked = 0
        self.known: frozenset[str] | None = None

    def push(self, name: str, labels: list[str]) -> None:
        self.stack.append((name, labels))
        self.around.update(labels)
        self.open[name] += 1
        self.known = None
        self.links += name == "a"
        self.silent += name in SILENT

    def pop(self) -> None:
        name, labels = self.stack.pop()
        self.open[name] -= 1
        for label in labels:
            self.around[label] -= 1
            if not self.around[label]:
                del self.around[label]
        self.known = None
        self.links -= name == "a"
        self.silent -= name in SILENT

    def close(self, names: frozenset[str] | set[str], fences: set[str]) -> None:
        """Close the nearest open element of these names that no fence hides."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in names:
                while len(self.stack) > at:
                    self.pop()
                return
            if self.stack[at][0] in fences:
                return

    def text(self, raw: str) -> None:
        if raw and not self.silent:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.links:
                self.linked += len(text)

    def leaf(self) -> Iterator[Leaf]:
        """What has been read since the last block boundary."""
        if self.parts:
            line = " ".join("".join(self.parts).split())
            self.parts.clear()
            if line:
                blocks = islice((n for n, _ in reversed(self.stack) if n in BLOCKS), 2)
                if self.known is None:
                    self.known = frozenset(self.around)
                yield Leaf(line, self.known, " ".join(blocks), self.linked, len(self.stack))
        self.linked = 0


_P = frozenset(["p"])
_P_FENCES = BLOCKS - _P | {"button"}


def leaves(page: str) -> Iterator[Leaf]:
    """The leaf blocks of a page in order. Text in the head, scripts, styles and the like is none."""
    reader = _Reader()
    at = 0
    while True:
        start = page.find("<", at)
        if start < 0:
            reader.text(page[at:])
            break
        found = _TAG.match(page, start)
        if found is None:  # a plain sign
            reader.text(page[at : start + 1])
            at = start + 1
            continue
        reader.text(page[at:start])
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        block = name in BLOCKS
        if block or name == "textarea":
            yield from reader.leaf()
        if closing:
            if reader.open[name]:
                reader.close({name}, set())
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if block:
            reader.close(_P, _P_FENCES)
            if name in IMPLIED:
                reader.close(*IMPLIED[name])
        if name == "br":
            reader.parts.append(" ")
        if name not in VOID:
            reader.push(name, _labels(name, attributes))
    yield from reader.leaf()
