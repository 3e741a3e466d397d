"""Toxicity by class-conditional Kneser-Ney models.

Two models spell words character by character, one learnt from toxic and one from ordinary texts. The difference of a
word's log-likelihoods tells how much it speaks for either class; a rare or inflected expression is judged by the
parts it shares with others. A word is one word whatever its length: its value is the sum over its bytes, and that of the
strongest stretch of three cells of ``CELL`` bytes where it has more, so an expression inside a long run of letters
stands out as it does elsewhere. The models of orders 3 to ``ORDER`` belong to their class, each backing off to the
continuation counts of the order below; orders 1 and 2 are shared, built from the larger of both classes' counts.

A logistic layer, fitted on rows that the models have not seen, turns length-normalised differences into a score: the
mean over the words, the strongest word, and the words that stand out, relative to the text's length. Its weights
restore the classes' real frequencies.

The models are fitted on bounded samples: of each class, the ``max_training_rows`` labelled rows with the lowest hash
of their id, as far as their text has at most ``MAX_TRAINING_BYTES``.

Definitions: a label is the largest of a document's labels; null labels are none. A null or empty text gets the score of
a text without evidence. With fewer than ``LEAST_TEXTS`` texts of either class there is no model, and every score is the
share of toxic labels (0 without labels). Of rows that repeat an id the least text is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import LETTER_WORDS, Words, mixed, powers, split_words, text_blocks

MAX_TRAINING_ROWS = 2000
MAX_TRAINING_BYTES = 1 << 17
LEAST_TEXTS = 3
ORDER = 6
SHARED_ORDER = 2
STANDS_OUT = 4.0
THRESHOLD = 0.3
REMEMBERED_WORDS = 1 << 20
SPELLED_AT_ONCE = 1 << 15
# Words are spelled in cells of this many bytes, each with the letters before it as context.
CELL = 32
_BASE = 0x9E3779B97F4A7C15
_EDGE = 32


class Parts:
    """Words cut into cells.

    A cell that does not open its word begins with ``lead`` bytes that are only context. Only ``last`` cells have an end
    mark.
    """

    def __init__(self, words: Words):
        sizes = words.ends - words.starts
        counts = np.maximum(1, -(-sizes // CELL))
        before = np.append(0, np.cumsum(counts))
        inner = np.arange(before[-1]) - np.repeat(before[:-1], counts)
        starts, ends = np.repeat(words.starts, counts) + inner * CELL, np.repeat(words.ends, counts)
        self.last = inner == np.repeat(counts, counts) - 1
        self.lead = np.where(inner > 0, ORDER - 1, 0)
        ends = np.where(self.last, ends, starts + CELL)
        self.words = Words(words.buffer, starts - self.lead, ends, before[words.bounds])
        self.first, self.counts = before[:-1], counts

    def hashes(self) -> np.ndarray:
        place = (self.lead > 0) * np.uint64(1) + ~self.last * np.uint64(2)
        return self.words.hashes() ^ place * np.uint64(_BASE)

    def word_values(self, values: np.ndarray) -> np.ndarray:
        """A value for each word from those of its cells: the largest sum of three cells in a row, or of all if there are fewer.
        """
        if (self.counts == 1).all():
            return values
        total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
        reach = np.minimum(np.arange(len(values)) + 3, np.repeat(self.first + self.counts, self.counts))
        sums = total[reach] - total[:-1]
        # Stretches that the word's end cuts short are parts of the one before them.
        inner = np.arange(len(values)) - np.repeat(self.first, self.counts)
        sums[(inner > 0) & (inner > np.repeat(self.counts, self.counts) - 3)] = -np.inf
        return np.maximum.reduceat(sums, self.first)


class Spelled:
    """Characters of the chosen words; ``owner`` is the word's place among the chosen.

    Each word has its end mark, unless ``last`` says that it is a part before the end.
    """

    def __init__(self, words: Words, which: np.ndarray, last: np.ndarray | None = None):
        starts = words.starts[which]
        sizes = words.ends[which] - starts
        lengths = sizes + (1 if last is None else last[which])
        self.owner = np.repeat(np.arange(len(which), dtype=np.int32), lengths)
        first = np.cumsum(lengths) - lengths
        self.inner = np.arange(len(self.owner)) - first[self.owner]
        place = np.minimum(starts[self.owner] + self.inner, len(words.buffer) - 1)
        codes = np.where(self.inner == sizes[self.owner], _EDGE, words.buffer[place])
        self.codes = codes.astype(np.uint64) + np.uint64(1)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, hashes of the run that ends at each character, and of that run without the character."""
        factor = powers(_BASE, ORDER)
        key = self.codes.copy()
        for k in range(ORDER):
            if k:
                before = np.full(len(key), _EDGE + 1, np.uint64)
                before[k:] = self.codes[:-k]
                before[self.inner < k] = _EDGE + 1
                key += before * factor[k]
            yield mixed(key + np.uint64(k << 56)), mixed(key - self.codes + np.uint64(k << 56 | 1 << 60))


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted hash among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Spelling:
    """Kneser-Ney tables; a column for each class."""

    runs: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    masses: list[np.ndarray] = field(default_factory=list)

    def differences(self, parts: Parts, which: np.ndarray) -> np.ndarray:
        """Log-likelihood of each chosen part as toxic less that as ordinary."""
        found = np.empty(len(which))
        for low in range(0, len(which), SPELLED_AT_ONCE):
            part = which[low : low + SPELLED_AT_ONCE]
            letters = Spelled(parts.words, part, parts.last)
            p = np.full((len(letters.owner), 2), 1 / 257)
            for k, (runs, contexts) in enumerate(letters.runs()):
                at, there = _lookup(self.contexts[k], contexts)
                p *= np.where(there[:, None], self.masses[k][at], 1.0)
                at, there = _lookup(self.runs[k], runs)
                p += np.where(there[:, None], self.shares[k][at], 0.0)
            value = np.log(p[:, 1]) - np.log(p[:, 0])
            value[letters.inner < parts.lead[part][letters.owner]] = 0
            found[low : low + SPELLED_AT_ONCE] = np.bincount(letters.owner, value, minlength=len(part))
        return found


def _discount(counts: np.ndarray) -> float:
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return min(0.9, max(0.1, once / max(1.0, once + 2 * twice)))


def estimate(words: Words, which: np.ndarray, times: np.ndarray) -> Spelling:
    """Tables from distinct words and how often each occurs in either class (a column each)."""
    model = Spelling()
    letters = Spelled(words, which)
    # One row for each distinct run of the highest order; shorter runs end in it.
    for longest, _ in letters.runs():
        pass
    distinct, place = np.unique(longest, return_inverse=True)
    del longest
    counts = np.stack([np.bincount(place, times[letters.owner, c], minlength=len(distinct)) for c in (0, 1)], 1)
    first = np.zeros(len(distinct), np.int64)
    first[place] = np.arange(len(place))
    del place
    runs, contexts = zip(*((r[first], c[first]) for r, c in letters.runs()), strict=True)
    first = np.arange(len(distinct))
    for k in range(ORDER - 1, -1, -1):
        if k < SHARED_ORDER:
            counts = np.repeat(counts.max(axis=1, keepdims=True), 2, axis=1)
        context_keys, context = np.unique(contexts[k][first], return_inverse=True)
        total = np.stack([np.bincount(context, counts[:, c], minlength=len(context_keys)) for c in (0, 1)], 1)
        kinds = np.stack([np.bincount(context, counts[:, c] > 0, minlength=len(context_keys)) for c in (0, 1)], 1)
        off = np.array([_discount(counts[:, c]) for c in (0, 1)])
        shares = np.maximum(counts - off, 0) / np.maximum(total[context], 1)
        masses = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
        model.runs.insert(0, distinct)
        model.shares.insert(0, shares.astype(np.float32))
        model.contexts.insert(0, context_keys)
        model.masses.insert(0, masses.astype(np.float32))
        if k:
            # A shorter run counts once for each different run that it ends.
            shorter, place = np.unique(runs[k - 1][first], return_inverse=True)
            counts = np.stack([np.bincount(place, counts[:, c] > 0, minlength=len(shorter)) for c in (0, 1)], 1).astype(float)
            next_first = np.zeros(len(shorter), np.int64)
            next_first[place] = first
            distinct, first = shorter, next_first
    return model


class Memory:
    """The differences of parts seen lately; a new one takes the place of an old one with the same slot."""

    def __init__(self):
        self.keys = np.zeros(REMEMBERED_WORDS, np.uint64)
        self.values = np.zeros(REMEMBERED_WORDS, np.float32)

    def differences(self, spelling: Spelling, parts: Parts) -> np.ndarray:
        hashes = parts.hashes()
        slots = (hashes >> np.uint64(13)) & np.uint64(REMEMBERED_WORDS - 1)
        values = self.values[slots]
        missing = np.flatnonzero(self.keys[slots] != hashes)
        if len(missing):
            _, first, place = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new = missing[first]
            found = spelling.differences(parts, new)
            values[missing] = found[place]
            self.keys[slots[new]] = 0  # if two new words share a slot, the key and value of one are kept together
            self.keys[slots[new]], self.values[slots[new]] = hashes[new], found
        return values


@dataclass
class Scorer:
    spelling: Spelling
    mean: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))  # of the features, then a last one
    constant: float | None = None  # the score of all texts where there is no model

    def features(self, words: Words, memory: Memory) -> np.ndarray:
        bounds = words.bounds
        n = np.diff(bounds)
        found = np.zeros((len(n), 4))
        some = n > 0
        if self.constant is not None or not some.any():
            return found
        parts = Parts(words)
        value = parts.word_values(memory.differences(self.spelling, parts))
        starts = bounds[:-1][some]
        found[some, 0] = np.add.reduceat(value, starts) / n[some]
        found[some, 1] = np.maximum.reduceat(value, starts)
        out = np.maximum(value - STANDS_OUT, 0)
        found[some, 2] = np.log1p(np.add.reduceat(out, starts))
        found[some, 3] = np.log1p(100 * np.add.reduceat(out, starts) / n[some])
        return found

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        z = (features - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _words_of(texts: list[str]) -> Words:
    raw = [t.encode() for t in pc.utf8_lower(pa.array(texts, pa.string())).to_pylist()]
    return split_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), LETTER_WORDS)


def _spelling_of(ordinary: list[str], toxic: list[str]) -> Spelling:
    words = _words_of(ordinary + toxic)
    _, which, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
    border = words.bounds[len(ordinary)]
    times = np.stack([np.bincount(part, minlength=len(which)) for part in (place[:border], place[border:])], 1)
    return estimate(words, which, times.astype(float))


def train(ordinary: list[str], toxic: list[str], toxic_share: float) -> Scorer:
    """Models from all texts, the logistic layer from features of texts that their model has not seen."""
    if min(len(ordinary), len(toxic)) < LEAST_TEXTS:
        return Scorer(Spelling(), constant=toxic_share)
    # Each third is read by models of the other two; the model that is kept learns from all.
    x, y = [], []
    for fold in range(3):
        part = Scorer(_spelling_of(*([t for i, t in enumerate(c) if i % 3 != fold] for c in (ordinary, toxic))))
        for mark, texts in enumerate((ordinary, toxic)):
            x.append(part.features(_words_of(texts[fold::3]), Memory()))
            y.append(np.full(len(x[-1]), float(mark)))
    scorer = Scorer(_spelling_of(ordinary, toxic))
    x, y = np.concatenate(x), np.concatenate(y)
    weight = np.where(y == 1, toxic_share / len(toxic), (1 - toxic_share) / len(ordinary)) * len(y)
    scorer.mean, scorer.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - scorer.mean) / scorer.scale, np.ones(len(y))])
    w = np.zeros(5)
    ridge = np.diag([0.5, 0.5, 0.5, 0.5, 1e-3])
    for _ in range(60):  # Newton steps of a penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        slope = z.T @ (weight * (y - p)) - ridge @ w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.clip(np.linalg.solve(bend, slope), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    scorer.weights = w
    return scorer


def fit(documents: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> Scorer:
    """Learn from labelled documents; of each class at most ``max_training_rows``."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, positive = marks.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    share = positive / n if n else 0.0
    texts = {}
    for value in (0, 1):
        drawn = marks.filter(F.col("toxic") == value).select("doc_id", F.xxhash64("doc_id").alias("draw"))
        drawn = drawn.orderBy("draw", "doc_id").limit(max_training_rows).select("doc_id")
        rows = documents.filter(F.octet_length("text") <= MAX_TRAINING_BYTES).join(F.broadcast(drawn), "doc_id")
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # one for each drawn id
        texts[value] = [text for _, text in sorted((r["doc_id"], r["text"]) for r in rows)]
    return train(texts[0], texts[1], share)


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = shared.value
        memory = Memory()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            lowered = pa.RecordBatch.from_pydict({"text": pc.utf8_lower(batch.column(batch.schema.get_field_index("text")))})
            for low, high, data, offsets in text_blocks(lowered, "text"):
                words = split_words(data, offsets, LETTER_WORDS)
                score = scorer.scores(scorer.features(words, memory))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(low, high - low),
                        "score": pa.array(score, pa.float64()),
                        "predicted": pa.array((score >= threshold).astype(np.int32)),
                    }
                )

    return run


def score(documents: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """Toxicity of each whole text: ``doc_id``, ``score``, ``predicted``. The broadcast model is bounded by its sample."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)
    return documents.select("doc_id", "text").mapInArrow(
        _score(shared, threshold), "doc_id long, score double, predicted int"
    )
