"""A recurrent labeller of a page's blocks in numpy: vectors of tag path and words, and an LSTM in each direction.

A block's vector is the sum of the embeddings of the names around it, the embedding of its own element, the mean of its
words' embeddings and a few measures. Both directions read all blocks of the page; the label of each is logistic in
both states and the vector itself. Training is stochastic gradient descent (Adam) through time, with a fixed seed.

Pages of a batch are packed: at each step the states of all pages that still have a block move at once, so no padding is
computed and the cost follows the blocks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from .html_blocks import Leaf
from .tokens import LETTER_WORDS, split_words

NAMES, OWNS, WORDS = 4096, 512, 4096  # buckets
NAME_SIZE, OWN_SIZE, WORD_SIZE, MEASURES, STATE = 24, 8, 12, 8, 24
INPUT = NAME_SIZE + OWN_SIZE + WORD_SIZE + MEASURES
TEXT_AT_ONCE = 1 << 20
EPOCHS, PAGES_AT_ONCE, RATE, WORDS_UNSEEN = 8, 16, 0.01, 0.4

_buckets: dict[tuple[str, int], int] = {}


def _bucket(label: str, count: int) -> int:
    found = _buckets.get((label, count))
    if found is None:
        if len(_buckets) > 1 << 16:
            _buckets.clear()
        found = _buckets[label, count] = zlib.crc32(label.encode("utf-8", "replace")) % count
    return found


@dataclass
class Blocks:
    """The blocks of some pages, one after the other, as numbers."""

    sizes: np.ndarray  # blocks of each page
    names: np.ndarray
    name_starts: np.ndarray
    owns: np.ndarray
    words: np.ndarray
    word_counts: np.ndarray
    measures: np.ndarray


def _word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found, counts, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while low < len(texts):
        high, size = low, 0
        raw = []
        while high < len(texts) and (size < TEXT_AT_ONCE or high == low):
            raw.append(texts[high].encode("utf-8", "replace"))
            size += len(raw[-1])
            high += 1
        words = split_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), LETTER_WORDS)
        found.append((words.hashes() % np.uint64(WORDS)).astype(np.int64))
        counts.append(np.diff(words.bounds))
        low = high
    return np.concatenate(found), np.concatenate(counts)


def blocks_of(pages: list[list[Leaf]]) -> Blocks:
    sizes = np.array([len(p) for p in pages], np.int64)
    flat = [leaf for p in pages for leaf in p]
    paths = [[_bucket("", NAMES), *{_bucket(n, NAMES) for n in leaf.path}] for leaf in flat]
    words, word_counts = _word_buckets([leaf.text for leaf in flat])
    chars = np.array([len(leaf.text) for leaf in flat], float)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    measures = np.stack(
        [
            np.log1p(word_counts) / 4,
            np.log1p(chars) / 6,
            np.minimum(1, np.array([leaf.linked for leaf in flat], float) / np.maximum(chars, 1)),
            np.array([leaf.text[-1] in ".!?" for leaf in flat], float),
            np.array([leaf.depth for leaf in flat], float) / (5 + np.array([leaf.depth for leaf in flat], float)),
            np.log1p(place) / 5,
            np.log1p(np.repeat(sizes, sizes) - 1 - place) / 5,
            np.ones(len(flat)),
        ],
        axis=1,
    ) if flat else np.zeros((0, MEASURES))
    return Blocks(
        sizes,
        np.array([n for p in paths for n in p], np.int64),
        np.cumsum([0, *map(len, paths)])[:-1],
        np.array([_bucket(leaf.own, OWNS) for leaf in flat], np.int64),
        words,
        word_counts,
        measures.astype(np.float32),
    )


class _Packing:
    """Where the blocks of pages stand when the pages are read step by step, longest first."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
        longest = int(sizes.max(initial=0))
        self.active = np.searchsorted(-sizes, -np.arange(longest), "left")
        self.offsets = np.append(0, np.cumsum(self.active))
        page = np.arange(self.offsets[-1]) - np.repeat(self.offsets[:-1], self.active)
        step = np.repeat(np.arange(longest), self.active)
        self.ahead = starts[page] + step
        self.back = starts[page] + sizes[page] - 1 - step


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(z: np.ndarray, recurrent: np.ndarray, packing: _Packing, kept: list | None) -> np.ndarray:
    """States of one direction; ``z`` holds the packed inputs to the gates."""
    width = packing.active[0] if len(packing.active) else 0
    h, c = np.zeros((width, STATE), np.float32), np.zeros((width, STATE), np.float32)
    out = np.empty((len(z), STATE), np.float32)
    for low, k in zip(packing.offsets, packing.active, strict=False):
        h, c = h[:k], c[:k]
        gates = z[low : low + k] + h @ recurrent
        pass_, new = _sigmoid(gates[:, : 3 * STATE]), np.tanh(gates[:, 3 * STATE :])
        i, f, o = pass_[:, :STATE], pass_[:, STATE : 2 * STATE], pass_[:, 2 * STATE :]
        before_h, before_c = h, c
        c = f * c + i * new
        squashed = np.tanh(c)
        h = o * squashed
        out[low : low + k] = h
        if kept is not None:
            kept.append((i, f, o, new, squashed, before_h, before_c))
    return out


def _unread(slope: np.ndarray, recurrent: np.ndarray, packing: _Packing, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the gates' inputs and of the recurrent weights from those of the states."""
    back = np.empty((len(slope), 4 * STATE), np.float32)
    of_weights = np.zeros_like(recurrent)
    dh = dc = np.zeros((0, STATE), np.float32)
    for low, k, (i, f, o, new, squashed, before_h, before_c) in zip(packing.offsets[-2::-1], packing.active[::-1], kept[::-1], strict=True):
        grown = np.zeros((2, k, STATE), np.float32)
        grown[0, : len(dh)], grown[1, : len(dc)] = dh, dc
        dh, dc = grown[0] + slope[low : low + k], grown[1]
        dc = dc + dh * o * (1 - squashed**2)
        gates = back[low : low + k]
        gates[:, :STATE] = dc * new * i * (1 - i)
        gates[:, STATE : 2 * STATE] = dc * before_c * f * (1 - f)
        gates[:, 2 * STATE : 3 * STATE] = dh * squashed * o * (1 - o)
        gates[:, 3 * STATE :] = dc * i * (1 - new**2)
        of_weights += before_h.T @ gates
        dh, dc = gates @ recurrent.T, dc * f
    return back, of_weights


class Labeller:
    """Weights by name; ``ahead`` and ``back`` are the two directions."""

    def __init__(self, seed: int = 13):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, by: (draw.normal(size=shape) * by).astype(np.float32)
        self.w = {"names": normal(NAMES, NAME_SIZE, by=0.1), "owns": normal(OWNS, OWN_SIZE, by=0.1), "words": normal(WORDS, WORD_SIZE, by=0.1)}
        for way in ("ahead", "back"):
            self.w[way + "_in"] = normal(INPUT, 4 * STATE, by=INPUT**-0.5)
            self.w[way + "_state"] = normal(STATE, 4 * STATE, by=STATE**-0.5)
            self.w[way + "_bias"] = np.concatenate([np.zeros(STATE), np.ones(STATE), np.zeros(2 * STATE)]).astype(np.float32)
        self.w["out"], self.w["out_bias"] = normal(2 * STATE + INPUT, by=0.1), np.zeros(1, np.float32)

    def vectors(self, blocks: Blocks) -> np.ndarray:
        x = np.zeros((len(blocks.owns), INPUT), np.float32)
        if not len(x):
            return x
        x[:, :NAME_SIZE] = np.add.reduceat(self.w["names"][blocks.names], blocks.name_starts)
        x[:, NAME_SIZE : NAME_SIZE + OWN_SIZE] = self.w["owns"][blocks.owns]
        some = np.flatnonzero(blocks.word_counts)
        starts = (np.cumsum(blocks.word_counts) - blocks.word_counts)[some]
        low = 0
        while low < len(some):  # a bounded number of words at a time
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + TEXT_AT_ONCE // 8)))
            end = starts[high] if high < len(some) else len(blocks.words)
            sums = np.add.reduceat(self.w["words"][blocks.words[starts[low] : end]], starts[low:high] - starts[low])
            x[some[low:high], NAME_SIZE + OWN_SIZE : -MEASURES] = sums / blocks.word_counts[some[low:high], None]
            low = high
        x[:, -MEASURES:] = blocks.measures
        return x

    def _states(self, x: np.ndarray, packing: _Packing, kept: dict | None = None) -> np.ndarray:
        found = np.empty((len(x), 2 * STATE), np.float32)
        for n, (way, order) in enumerate((("ahead", packing.ahead), ("back", packing.back))):
            notes = None if kept is None else kept.setdefault(way, [])
            z = x[order] @ self.w[way + "_in"] + self.w[way + "_bias"]
            found[order, n * STATE : (n + 1) * STATE] = _read(z, self.w[way + "_state"], packing, notes)
        return found

    def probabilities(self, blocks: Blocks) -> np.ndarray:
        """How likely each block is main text."""
        x = self.vectors(blocks)
        if not len(x):
            return np.zeros(0)
        packing = _Packing(blocks.sizes[blocks.sizes > 0])
        return _sigmoid(np.concatenate([self._states(x, packing), x], axis=1) @ self.w["out"] + self.w["out_bias"])

    def slopes(self, blocks: Blocks, marks: np.ndarray, unseen: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss of some pages and its slope by every weight; the words of ``unseen`` blocks are left out."""
        x = self.vectors(blocks)
        at_words = slice(NAME_SIZE + OWN_SIZE, INPUT - MEASURES)
        x[unseen, at_words] = 0
        packing = _Packing(blocks.sizes)
        kept: dict[str, list] = {}
        both = np.concatenate([self._states(x, packing, kept), x], axis=1)
        p = _sigmoid(both @ self.w["out"] + self.w["out_bias"])
        loss = float(-np.mean(np.where(marks, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        error = ((p - marks) / len(marks)).astype(np.float32)
        g = {"out": both.T @ error, "out_bias": error.sum(keepdims=True)}
        of_both = error[:, None] * self.w["out"]
        of_x = of_both[:, 2 * STATE :].copy()
        for n, (way, order) in enumerate((("ahead", packing.ahead), ("back", packing.back))):
            z, g[way + "_state"] = _unread(of_both[order, n * STATE : (n + 1) * STATE], self.w[way + "_state"], packing, kept[way])
            g[way + "_in"], g[way + "_bias"] = x[order].T @ z, z.sum(axis=0)
            of_x[order] += z @ self.w[way + "_in"].T
        of_x[unseen, at_words] = 0
        for name, rows, owner, value in (
            ("names", blocks.names, np.repeat(np.arange(len(x)), np.diff(np.append(blocks.name_starts, len(blocks.names)))), of_x[:, :NAME_SIZE]),
            ("owns", blocks.owns, np.arange(len(x)), of_x[:, NAME_SIZE : NAME_SIZE + OWN_SIZE]),
            ("words", blocks.words, np.repeat(np.arange(len(x)), blocks.word_counts), of_x[:, at_words] / np.maximum(blocks.word_counts, 1)[:, None]),
        ):
            g[name] = np.zeros_like(self.w[name])
            np.add.at(g[name], rows, value[owner].astype(np.float32))
        return loss, g


def train(pages: list[tuple[list[Leaf], np.ndarray]], epochs: int = EPOCHS, seed: int = 13) -> Labeller:
    """Learn from the blocks and marks of pages."""
    labeller = Labeller(seed)
    draw = np.random.default_rng(seed)
    pages = [p for p in pages if p[0]]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in labeller.w.items()}
    batches = []
    order = sorted(range(len(pages)), key=lambda n: (len(pages[n][0]), n))
    for low in range(0, len(order), PAGES_AT_ONCE):  # pages of like length, so that steps are shared
        chosen = [pages[n] for n in order[low : low + PAGES_AT_ONCE]]
        batches.append((blocks_of([p for p, _ in chosen]), np.concatenate([m for _, m in chosen]).astype(bool)))
    step, total = 0, max(1, epochs * len(batches))
    for _ in range(epochs):
        for n in draw.permutation(len(batches)):
            blocks, marks = batches[n]
            _, slopes = labeller.slopes(blocks, marks, draw.random(len(marks)) < WORDS_UNSEEN)
            norm = np.sqrt(sum(float((s**2).sum()) for s in slopes.values()))
            rate = RATE * (1 - step / total) * min(1, 5 / max(norm, 1e-9))
            step += 1
            for k, s in slopes.items():
                first, second = moments[k]
                first += 0.1 * (s - first)
                second += 0.01 * (s * s - second)
                labeller.w[k] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return labeller
