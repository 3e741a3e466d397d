"""LM scoring with a weighted backoff automaton.

A state of the automaton is a context seen in training. It has an arc for each word seen behind it, with the word's
smoothed log-probability, and a failure arc to the next shorter context with the log of the mass that is left for other
words. A text is read once from left to right: at each word the state's own arc is taken, or failure arcs are followed
and their weights added until an arc is found. Probabilities are smoothed towards the next shorter context,

    p(w | context) = (count(context w) + strength * p(w | shorter)) / (count(context) + strength)

and the shortest one is add-one over the training words and one unknown word.

The n-gram table grows with the corpus, so it is never in one place. Documents are dealt into chunks by hash. Each chunk
sends the hashes of its distinct n-grams with their training counts to buckets, packed; a bucket sums the counts and
answers each chunk in the order of its question; the chunk then builds the part of the automaton that its texts can
reach and scores them. Common n-grams are summed within a chunk first, so no key is hot.

Definitions: A-Z are lower-cased, words are the runs between ASCII white space, then comes one end token; a null text is
empty. Rows that repeat an id are scored one by one. n-grams are told apart by 61-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .packing import pack, unpack
from .tokens import LOWER_WORDS, mixed, split_words, text_blocks

ORDER = 2
STRENGTH = 200.0
CHUNK_BYTES = 6 << 20
# A bucket answers about as many n-grams as a chunk asks for.
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_ORDER_BITS = np.uint64(7)
_START = np.uint64(8)
_END = np.uint64(16)


class Tokens:
    """Tokens of a chunk of texts, each text with a start and an end token, and their n-grams."""

    def __init__(self, table: pa.Table, order: int):
        texts = pa.RecordBatch.from_arrays([pa.concat_arrays(table.column("text").chunks or [pa.array([], pa.string())])], ["text"])
        hashes, bounds = [], [np.zeros(1, np.int64)]
        for _, _, data, offsets in text_blocks(texts, "text"):
            words = split_words(data, offsets, LOWER_WORDS)
            hashes.append(words.hashes())
            bounds.append(words.bounds[1:] + bounds[-1][-1])
        words, edges = (np.concatenate(x) for x in (hashes or [np.zeros(0, np.uint64)], bounds))
        n = len(edges) - 1
        self.sizes = np.diff(edges) + 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        inside = np.ones(total, bool)
        inside[self.starts] = False
        inside[self.starts + self.sizes - 1] = False
        tokens = np.empty(total, np.uint64)
        tokens[inside] = mixed(words) & ~np.uint64(255)
        tokens[self.starts] = _START
        tokens[self.starts + self.sizes - 1] = _END
        self.text = np.repeat(np.arange(n), self.sizes)
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # distinct keys, a place of each, key of each token
        key, place = tokens, np.arange(total) - self.starts[self.text]
        for k in range(1, order + 1):
            if k > 1:
                longer = np.zeros(total, np.uint64)
                longer[1:] = mixed(key[:-1] * _PAIR + tokens[1:])
                key = longer
            tagged = (key & ~_ORDER_BITS) | np.uint64(k)
            at = np.flatnonzero(place >= k - 1)
            distinct, first, which = np.unique(tagged[at], return_index=True, return_inverse=True)
            owner = np.full(total, -1, np.int64)
            owner[at] = which
            self.grams.append((distinct, at[first], owner))

    def questions(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All distinct n-grams in order of their hash, with their counts in the training texts."""
        counted = training[self.text]
        keys, counts = [], []
        for distinct, _, owner in self.grams:
            keys.append(distinct)
            counts.append(np.bincount(owner[counted & (owner >= 0)], minlength=len(distinct)))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        sort = np.argsort(keys)
        return keys[sort], counts[sort]


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _ask(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        training = table.column("training").to_numpy(zero_copy_only=False).astype(bool)
        keys, counts = Tokens(table, order).questions(training)
        edges = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
        rows, blobs = [], []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            steps = np.diff(keys[part], prepend=np.uint64(0))
            blobs.append(pack(steps, counts[part].astype(np.uint32)))
            rows.append(b)
        chunk = table.column("chunk")[0].as_py()
        return pa.table(
            {"bucket": pa.array(rows, pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "counts": pa.array(blobs, pa.binary())}
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Sums for each chunk that asked; the row without a chunk has the bucket's own totals."""
    parts = [unpack(x) for x in table.column("counts").to_pylist()]
    keys = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, _ in parts])
    counts = np.concatenate([c for _, c in parts]).astype(np.int64)
    distinct, which = np.unique(keys, return_inverse=True)
    sums = np.bincount(which, counts, minlength=len(distinct)).astype(np.int64)
    single = ((distinct & _ORDER_BITS) == 1) & (distinct != (_START | np.uint64(1)))
    edges = np.cumsum([0, *(len(c) for _, c in parts)])
    answers = [pack(sums[which[a:b]].astype(np.uint64)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    bucket = table.column("bucket")[0].as_py()
    n = len(parts)
    return pa.table(
        {
            "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
            "bucket": pa.array([bucket] * (n + 1), pa.int64()),
            "counts": pa.array([*answers, None], pa.binary()),
            "n_tokens": pa.array([None] * n + [int(sums[single].sum())], pa.int64()),
            "n_types": pa.array([None] * n + [int((sums[single] > 0).sum())], pa.int64()),
        }
    )


class Automaton:
    """Arcs and failure arcs of the states that a chunk's texts reach."""

    def __init__(self, tokens: Tokens, counts: list[np.ndarray], total: int, types: int, strength: float):
        self.tokens, self.counts = tokens, counts
        shares = (counts[0] + 1) / (total + types + 1)
        self.arcs, self.failures = [np.log10(shares)], []
        for k in range(1, len(counts)):
            _, at, _ = tokens.grams[k]
            shorter = tokens.grams[k - 1][2]
            context = counts[k - 1][shorter[at - 1]]
            shares = (counts[k] + strength * shares[shorter[at]]) / (context + strength)
            self.arcs.append(np.log10(shares))
            self.failures.append(np.log10(strength / (counts[k - 1] + strength)))

    def read(self) -> np.ndarray:
        """Log-probability of each token of each text, start tokens at 0."""
        tokens = self.tokens
        value = self.arcs[0][tokens.grams[0][2]]
        for k in range(1, len(self.arcs)):
            owner = tokens.grams[k][2]
            reached = np.flatnonzero(owner >= 0)
            found = self.counts[k][owner[reached]] > 0
            explicit, fails = reached[found], reached[~found]
            value[fails] += self.failures[k - 1][tokens.grams[k - 1][2][fails - 1]]
            value[explicit] = self.arcs[k][owner[explicit]]
        value[tokens.starts] = 0
        return value


def _score(order: int, total: int, types: int, strength: float):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if not len(texts):
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        tokens = Tokens(texts, order)
        in_order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        blobs = answers.column("counts").to_pylist()
        answered = np.concatenate([unpack(blobs[i])[0] for i in in_order]).astype(np.int64)
        keys = np.concatenate([g[0] for g in tokens.grams])
        counts = np.empty(len(keys), np.int64)
        counts[np.argsort(keys)] = answered
        counts = np.split(counts, np.cumsum([len(g[0]) for g in tokens.grams])[:-1])
        value = Automaton(tokens, counts, total, types, strength).read()
        word_counts = counts[0][tokens.grams[0][2]]
        base = np.log10((word_counts + 1) / (total + types + 1))
        base[tokens.starts] = 0
        known = word_counts > 0
        known[tokens.starts] = False
        add = lambda x: np.add.reduceat(x, tokens.starts)
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": pa.array(~texts.column("training").to_numpy(zero_copy_only=False).astype(bool)),
                "n_tokens": pa.array(tokens.sizes - 1, pa.int64()),
                "n_known": pa.array(add(known.astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(texts), total), pa.int64()),
                "base_score": pa.array(add(base), pa.float64()),
                "score": pa.array(add(value), pa.float64()),
            }
        )

    return run


def score(
    documents: DataFrame, training: Column, order: int = ORDER, strength: float = STRENGTH, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Score all texts by a model of those for which ``training`` holds.

    Columns: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (by single words, add-one) and ``score`` (log10 probability by the automaton).
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(8, -(-size // chunk_bytes))
    dealt = documents.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(training, F.lit(False)).alias("training"),
    )
    asked = dealt.groupBy("chunk").applyInArrow(_ask(order, chunks), "bucket long, chunk long, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(
        _answer, "chunk long, bucket long, counts binary, n_tokens long, n_types long"
    )
    answered = cut_lineage(answered, "counts")
    total, types = answered.filter("chunk IS NULL").agg(F.sum("n_tokens"), F.sum("n_types")).first()
    answers = answered.filter("chunk IS NOT NULL").select("chunk", "bucket", "counts")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(order, int(total or 0), int(types or 0), strength),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
