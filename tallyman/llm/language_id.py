"""Language ID: averaged embeddings of hashed character runs under a linear softmax, with calibrated rejection.

A text is lower-cased and everything but letters becomes a blank. Each run of 1 to 4 bytes inside a word, with its
edges, is hashed to one of ``BUCKETS`` embeddings; their mean goes through a linear layer and a softmax. Embeddings and
layer are trained together by stochastic gradient descent in numpy. As everything before the softmax is linear, the
trained model is one table of class scores for each bucket, and a whole text is scored by one vectorised pass.

The classifier is fitted on a bounded sample: the ``max_training_rows`` labelled rows with the lowest hash of their id.
A fifth of the sample is kept back to fit a temperature (so that scores are probabilities) and the rejection.

A softmax only says which known language is nearest, so a text is rejected by how familiar its runs are: the mean log
frequency of its runs in the learnt texts, of each run in the language that has it most. The bound lies halfway between
the lowest hundredth of the texts kept back and the highest hundredth of texts that should go: the same texts judged
without their own language, and with their letters shuffled. A short text is rejected only if it is below the bound by
more than chance explains; the allowance, in errors of the mean, loses at most ``REJECT_SHARE`` of the texts kept back,
which are also cut to 60 and 20 bytes for that. Where both kinds overlap, the bound goes down to the texts kept back.
A text on which the softmax is undecided (below ``threshold``, at most ``REJECT_BELOW``) is rejected too.

Definitions: a text that is null or has no letter gets ``und``, score 0 and is rejected. Without any labelled row
every text gets that. Ties go to the first language in order of name. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import release_memory

UNKNOWN = "und"
BUCKETS = 1 << 15
DIMENSIONS = 16
RUNS = (1, 2, 3, 4)
MAX_TRAINING_BYTES = 1 << 17
MAX_TRAINING_ROWS = 4000
REJECT_SHARE = 0.0005
REJECT_BELOW = 0.35
# Buckets of the runs' frequencies; a multiple of BUCKETS, so that one hash serves both tables.
FREQUENCY_BUCKETS = 1 << 18
# Frequency of a run that was never seen.
_UNSEEN = 1e-6
# Errors of the mean that are allowed at least.
_ALLOWED_ERRORS = 4
BLOCK_BYTES = 1 << 20

_ASCII_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
_BLANKED = bytes(b if b in _ASCII_LETTERS or b >= 128 else 32 for b in range(256))
_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters, with one blank before and after each."""
    lowered = (text or "").lower()
    if not any(map(str.isalpha, lowered)):
        return b""
    if lowered.isascii():
        words = lowered.encode().translate(_BLANKED).split()
    else:
        words = _NO_LETTER.sub(" ", lowered).encode("utf-8", "surrogatepass").split()
    return b" " + b" ".join(words) + b" " if words else b""


def run_buckets(data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of bytes, and where it starts; runs do not go across a blank, except at their edges."""
    n = len(data)
    found, places = [], []
    key = np.zeros(n, np.uint64)
    blanks = np.zeros(n, np.int8)
    for size in range(1, max(RUNS) + 1):
        m = n - size + 1
        if m <= 0:
            break
        last = data[size - 1 :]
        key = key[:m] * np.uint64(0x100000001B3) + last.astype(np.uint64) + np.uint64(1)
        # A blank may only be the first or the last byte of a run.
        inner = blanks[:m]
        if size in RUNS:
            ok = inner == 0
            if size == 1:
                ok = data != 32
            if size == 2:  # two blanks lie between two texts
                ok = (data[:m] != 32) | (last != 32)
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed >> np.uint64(40)) % np.uint64(buckets)
            at = np.flatnonzero(ok)
            found.append(mixed[at].astype(np.int32))
            places.append(at)
        blanks = inner + (last == 32) * np.int8(size > 1)
    return np.concatenate(found), np.concatenate(places)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float
    familiar: np.ndarray | None = None  # log frequency of each bucket's runs
    least_familiar: float = -np.inf
    allowance: float = 0.0  # divided by the root of the number of runs

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        forms = [letters(t) for t in texts]
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))
        familiar = np.zeros(len(texts))
        low = 0
        while low < len(forms):
            high, size = low, 0
            while high < len(forms) and (high == low or size + len(forms[high]) <= BLOCK_BYTES):
                size += len(forms[high])
                high += 1
            joined = b"".join(forms[low:high])
            edges = np.cumsum([0, *map(len, forms[low:high])])
            # A very long text is summed in parts that overlap by a run.
            for a in range(0, max(1, len(joined)), BLOCK_BYTES):
                part = np.frombuffer(joined[a : a + BLOCK_BYTES + max(RUNS) - 1], np.uint8)
                if not len(part):
                    continue
                runs, places = run_buckets(part, FREQUENCY_BUCKETS)
                mine = places < BLOCK_BYTES
                runs = runs[mine]
                buckets = runs % len(self.table)
                owner = np.searchsorted(edges, places[mine] + a, "right") - 1
                counts[low:high] += np.bincount(owner, minlength=high - low)
                for k in range(len(self.languages)):
                    sums[low:high, k] += np.bincount(owner, self.table[buckets, k], minlength=high - low)
                if self.familiar is not None:
                    familiar[low:high] += np.bincount(owner, self.familiar[runs], minlength=high - low)
            low = high
        known = counts > 0
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True, initial=-1e9)
        shares = np.exp(logits)
        shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = shares.argmax(axis=1)
        score = np.where(known, shares[np.arange(len(texts)), best], 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
        n = np.maximum(counts, 1)
        strange = familiar / n < self.least_familiar - self.allowance / np.sqrt(n)
        return names, score, ~known | (score < self.threshold) | strange


def train(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over single texts; texts are also shown cut to a few words."""
    languages = sorted(set(langs))
    pairs = [(letters(t), languages.index(k)) for t, k in zip(texts, langs, strict=True)]
    pairs = [(form, k) for form, k in pairs if form]
    random = np.random.default_rng(seed)
    n_lang = len(languages)
    vectors = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = random.normal(0, 0.3, (DIMENSIONS, max(1, n_lang))).astype(np.float32)
    bias = np.zeros(max(1, n_lang), np.float32)
    if n_lang == 0 or not pairs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)

    def sample(form: bytes) -> np.ndarray:
        # Lengths from a few words to about a page, so that short texts are learnt too.
        size = int(2 ** random.uniform(4, 11))
        at = int(random.integers(0, max(1, len(form) - size)))
        cut = form[at : at + size]
        if len(form) > size:
            cut = cut[cut.find(b" ") if b" " in cut[:-1] else 0 :]
        return run_buckets(np.frombuffer(cut, np.uint8), BUCKETS)[0]

    order = random.permutation(len(pairs))
    kept_back, learning = order[: len(order) // 5], order[len(order) // 5 :]
    learning = learning if len(learning) else order
    steps, done = epochs * len(learning), 0
    for _ in range(epochs):
        for i in random.permutation(learning):
            form, truth = pairs[i]
            buckets = sample(form)
            step = rate * (1 - done / steps)
            done += 1
            if not len(buckets):
                continue
            used, times = np.unique(buckets, return_counts=True)
            weights = (times / len(buckets)).astype(np.float32)
            mean = weights @ vectors[used]
            logits = mean @ layer + bias
            shares = np.exp(logits - logits.max())
            shares /= shares.sum()
            shares[truth] -= 1
            back = layer @ shares
            layer -= 0.1 * step * np.outer(mean, shares)
            bias -= 0.01 * step * shares
            vectors[used] -= step * np.outer(weights, back)
    model = Model(languages, vectors @ layer, bias, 1.0, 0.0)
    if len(kept_back):
        _calibrate(model, [pairs[i] for i in kept_back], random)
        _calibrate_familiar(model, [pairs[i] for i in learning], [pairs[i] for i in kept_back], random)
    return model


def _runs_of(form: bytes) -> Iterator[np.ndarray]:
    """Buckets of a text's runs for their frequencies, a bounded stretch at a time."""
    for a in range(0, len(form), BLOCK_BYTES):
        runs, places = run_buckets(np.frombuffer(form[a : a + BLOCK_BYTES + max(RUNS) - 1], np.uint8), FREQUENCY_BUCKETS)
        yield runs[places < BLOCK_BYTES]


def _shuffled(form: bytes, random: np.random.Generator) -> bytes:
    """The text with its letters in random order and its blanks where they were."""
    symbols = form.decode("utf-8", "replace")
    some = [c for c in symbols if c != " "]
    mixed = iter(random.permutation(len(some)).tolist())
    return "".join(" " if c == " " else some[next(mixed)] for c in symbols).encode()


def _calibrate_familiar(
    model: Model, learnt: list[tuple[bytes, int]], kept_back: list[tuple[bytes, int]], random: np.random.Generator
) -> None:
    """Frequencies of runs in the learnt texts, and the bound below which a text is of no learnt language."""
    n_lang = len(model.languages)
    # The largest share of each bucket among the languages, whose it is, and the largest of the others.
    most, second = np.zeros(FREQUENCY_BUCKETS), np.zeros(FREQUENCY_BUCKETS)
    whose = np.zeros(FREQUENCY_BUCKETS, np.int32)
    for k in range(n_lang):
        share = np.zeros(FREQUENCY_BUCKETS)
        for runs in _runs_of(b"".join(form for form, of in learnt if of == k)):
            share += np.bincount(runs, minlength=FREQUENCY_BUCKETS)
        share /= max(share.sum(), 1)
        second = np.maximum(second, np.minimum(most, share))
        whose[share > most] = k
        most = np.maximum(most, share)
    model.familiar = np.log(most + _UNSEEN).astype(np.float32)

    def mean(table: np.ndarray, form: bytes) -> tuple[float, int]:
        total, n = 0.0, 0
        for runs in _runs_of(form):
            total, n = total + float(table[runs].sum(dtype=np.float64)), n + len(runs)
        return total / max(n, 1), n

    whole = np.array([mean(model.familiar, form)[0] for form, _ in kept_back])
    strange = [mean(model.familiar, _shuffled(form, random))[0] for form, _ in kept_back]
    for k in range(n_lang) if n_lang > 1 else ():
        left_out = np.log(np.where(whose == k, second, most) + _UNSEEN)
        strange += [mean(left_out, form)[0] for form, of in kept_back if of == k]
    low, high = np.quantile(whole, 0.01), np.quantile(strange, 0.99)
    model.least_familiar = float((low + high) / 2 if high < low else np.quantile(whole, REJECT_SHARE))
    cut = [mean(model.familiar, form[:size]) for form, _ in kept_back for size in (len(form), 60, 20)]
    values, n = np.array([m for m, _ in cut]), np.array([n for _, n in cut])
    needed = (model.least_familiar - values) * np.sqrt(n)
    short = n <= np.quantile(n, 0.6)  # of long texts the subject varies more than chance
    error = float(np.std((values - np.median(whole))[short] * np.sqrt(n[short])))
    model.allowance = float(max(_ALLOWED_ERRORS * error, np.quantile(needed, 1 - REJECT_SHARE)))


def _calibrate(model: Model, pairs: list[tuple[bytes, int]], random: np.random.Generator) -> None:
    logits, truths = [], []
    for form, truth in pairs:
        for size in (len(form), 60):  # whole texts and short ones
            buckets = run_buckets(np.frombuffer(form[:size], np.uint8), BUCKETS)[0]
            if len(buckets):
                logits.append(model.table[buckets].mean(axis=0) + model.bias)
                truths.append(truth)
    logits, truths = np.array(logits), np.array(truths)
    if not len(truths):
        return

    def shares(temperature: float) -> np.ndarray:
        z = logits / temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.1, 10, 60)
    loss = [-np.log(np.maximum(shares(t)[np.arange(len(truths)), truths], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    best = np.sort(shares(model.temperature).max(axis=1))
    model.threshold = float(min(best[0], REJECT_BELOW))  # no text kept back is below it


def fit(documents: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Learn from rows with a text and a language; the sample is bounded by ``max_training_rows`` of ``MAX_TRAINING_BYTES``.

    Of rows that repeat an id the one with the least text is learnt from; a row without id is not.
    """
    labelled = documents.filter((F.octet_length("text") <= MAX_TRAINING_BYTES) & F.col("lang").isNotNull())
    # The rows are drawn without their texts, which are then read for those rows alone.
    drawn = labelled.select("doc_id", F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id").limit(max_training_rows)
    rows = labelled.join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id").select("doc_id", "text", "lang")
    least = F.min(F.struct("text", "lang")).alias("row")
    rows = rows.groupBy("doc_id").agg(least).select("doc_id", "row.text", "row.lang")  # one for each drawn id
    sample = sorted((r["doc_id"], r["text"], r["lang"]) for r in rows.collect())
    return train([t for _, t, _ in sample], [k for _, _, k in sample])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            names, score, rejected = model.predict(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(score, pa.float64()),
                    "rejected": pa.array(rejected, pa.bool_()),
                }
            )
        release_memory()

    return run


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Language, calibrated score and rejection of each whole text: ``doc_id``, ``lang_pred``, ``score``, ``rejected``.

    The broadcast model has ``BUCKETS`` rows and one column a language, whatever the size of the data.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select("doc_id", "text").mapInArrow(
        _predict(shared), "doc_id long, lang_pred string, score double, rejected boolean"
    )


def _accepted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(~shared.value.predict(texts)[2]))
        release_memory()

    return run


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_accepted(shared), documents.schema)
