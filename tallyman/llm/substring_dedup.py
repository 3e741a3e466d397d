"""Substring dedup: words covered by a window that starts earlier in the corpus are removed.

A window is ``window`` consecutive words. The smallest hash of the short word runs inside a window is its minimiser;
neighbouring windows mostly share one, and such a run of windows (a super-k-mer) travels as one string to the bucket
of the minimiser, where all equal windows meet. There a sort by hash, place and a comparison of the words themselves
finds for each window whether it occurs earlier. Only the removed word ranges go back to the documents.

Documents are dealt into chunks by hash, and every step works on one chunk or one bucket at a time:

1. Strings that repeat within a chunk are decided there: all but the first are removed whole.
2. The chunk asks in how many strings of the corpus each of its minimisers occurs. Windows of a minimiser that
   occurs in a single string cannot repeat, so that string stays at home.
3. The other strings go to their bucket. If a minimiser has more than ``HOT_STRINGS`` strings, its windows travel one
   by one to the bucket of their own hash, so a common passage with many different surroundings spreads out. Of each
   such window a chunk sends the first only and decides the later ones itself, so a bucket gets it once a chunk.
4. The chunk removes the ranges that the buckets found.

Definitions: the order is by id (null first), then by text hash, then by start. Rows with the same id and text are one
document and get the same result; rows with the same id and other texts are documents of their own. A null text has no
words. Words are the runs between ASCII white space, unchanged; kept words are joined by one blank.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import pack, unpack
from .tokens import Words, mixed, range_hashes, release_memory, split_words

WINDOW = 20
MINIMISER_WORDS = 4
HOT_STRINGS = 1000
CHUNK_BYTES = 4 << 20
_RUN_BASE = 0xD1342543DE82EF95
_WINDOW_BASE = 0xAEF17502108EF2D9


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _runs(words: Words, window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and minimiser of each run of windows that share one, and whether it may repeat a window.

    A window that a run repeats holds the minimiser twice. A minimiser that stands once is shared by no more windows than
    a window has word runs, so only longer runs, or runs in which some word run returns soon, may repeat one.
    """
    n = len(words.starts)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n - part + 1)
    short = range_hashes(words.hashes(), at, at + part, _RUN_BASE)
    low = _sliding_min(short, window - part + 1)
    text = words.text_of_word()
    inside = text[: n - window + 1] == text[window - 1 :]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | (text[1 : n - window + 1] != text[: n - window])
    first = np.flatnonzero(opens)
    # The end of a run is the next window that opens another or lies across two texts.
    breaks = opens | ~inside
    after = np.append(np.flatnonzero(breaks), n - window + 1)
    last = after[np.searchsorted(after, first, "right")] - 1
    returns = np.zeros(len(short) + 1, np.int32)
    for distance in range(1, min(2 * window, len(short))):
        returns[1 + distance :] |= short[distance:] == short[:-distance]
    np.cumsum(returns, out=returns)
    end = last + window
    doubled = (end - first > 2 * window - part) | (returns[end - part + 1] > returns[first])
    return first, end, low[first], doubled


def _alone(first: np.ndarray, end: np.ndarray, key: np.ndarray, words: Words, window: int, hot: np.ndarray):
    """Runs of a hot minimiser cut into single windows, keyed by their own hash."""
    is_hot = np.isin(key, hot)
    if not is_hot.any():
        return first, end, key
    counts = end[is_hot] - first[is_hot] - window + 1
    base = np.repeat(first[is_hot] - np.append(0, np.cumsum(counts)[:-1]), counts)
    starts = base + np.arange(counts.sum())
    own = range_hashes(words.hashes(), starts, starts + window, _WINDOW_BASE)
    return (
        np.concatenate([first[~is_hot], starts]),
        np.concatenate([end[~is_hot], starts + window]),
        np.concatenate([key[~is_hot], own]),
    )


def _once(chunk: Chunk, first: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which single windows are the first of their words in the chunk, and the ranges of the later ones.

    Later windows that follow each other without a gap in one document make one range.
    """
    doc, text_key, start = chunk.places(first)
    order = _order(doc, text_key, start)
    opens, closes = chunk.words.starts[first].tolist(), chunk.words.ends[end - 1].tolist()
    leader: dict[bytes, int] = {}
    earliest = np.empty(len(first), np.int64)
    for i in order.tolist():
        earliest[i] = leader.setdefault(chunk.whole[opens[i] : closes[i]], i)
    again = earliest != np.arange(len(first))
    # Rows with the same id and text are one document; a window does not repeat itself.
    other = (doc != doc[earliest]) | (text_key != text_key[earliest]) | (start != start[earliest])
    gone = order[(again & other)[order]]
    doc, text_key, start = doc[gone], text_key[gone], start[gone]
    opens = np.append(True, (doc[1:] != doc[:-1]) | (text_key[1:] != text_key[:-1]) | (start[1:] > start[:-1] + 1))[: len(gone)]
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(gone))[: len(at)] - 1
    return ~again, (doc[at], text_key[at], start[at], (start[last] + window).astype(np.int32))


def _order(doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.lexsort((start, text, doc))


class Chunk:
    """The texts of one chunk and their distinct super-k-mers in corpus order."""

    def __init__(self, table: pa.Table, window: int, part: int):
        self.window = window
        raw = [pc.fill_null(c.cast(pa.large_binary()), b"") for c in table.column("text").chunks]
        raw = pa.concat_arrays(raw or [pa.array([], pa.large_binary())])
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8) if len(raw) else np.zeros(0, np.uint8)
        self.words = words = split_words(data[ends[0] : ends[-1]], ends - ends[0])
        self.doc = table.column("doc").to_numpy()
        self.text_key = table.column("text_key").to_numpy()
        first, end, key, doubled = _runs(words, window, part)
        text = words.text_of_word()[first]
        doc, text_key = self.doc[text], self.text_key[text]
        start = (first - words.bounds[text]).astype(np.int32)
        order = _order(doc, text_key, start)
        first, end, key, doubled, doc, text_key, start = (
            x[order] for x in (first, end, key, doubled, doc, text_key, start)
        )
        self.whole = words.buffer.tobytes()
        place: dict[bytes, int] = {}
        opens, closes = words.starts[first].tolist(), words.ends[end - 1].tolist()
        earliest = np.array([place.setdefault(self.whole[a:b], i) for i, (a, b) in enumerate(zip(opens, closes, strict=True))], np.int64)
        again = earliest != np.arange(len(first))
        other = ~((doc == doc[earliest]) & (text_key == text_key[earliest]) & (start == start[earliest]))
        removed, kept = again & other, ~again
        self.decided = doc[removed], text_key[removed], start[removed], (start + (end - first).astype(np.int32))[removed]
        self.first, self.end, self.key, self.doubled = first[kept], end[kept], key[kept], doubled[kept]

    def places(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document (two columns) and place in it of these words."""
        text = self.words.text_of_word()[first]
        return self.doc[text], self.text_key[text], (first - self.words.bounds[text]).astype(np.int32)

    def minimisers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimisers, the place of each string's one, and how many strings have each.

        A string that may repeat a window counts twice.
        """
        keys, which = np.unique(self.key, return_inverse=True)
        return keys, which, np.bincount(which, 1 + self.doubled, minlength=len(keys))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _message(bucket: list[int], chunk: int, packed: list[bytes]) -> pa.Table:
    return pa.table(
        {"bucket": pa.array(bucket, pa.int64()), "chunk": pa.array([chunk] * len(packed), pa.int64()), "packed": pa.array(packed, pa.binary())}
    )


_MESSAGE = "bucket long, chunk long, packed binary"


def _ask(window: int, part: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        keys, _, counts = Chunk(table, window, part).minimisers()
        edges = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
        rows = np.flatnonzero(np.diff(edges)).tolist()
        blobs = []
        for b in rows:
            asked = slice(edges[b], edges[b + 1])
            blobs.append(pack(np.diff(keys[asked], prepend=np.uint64(0)), counts[asked].astype(np.uint32)))
        release_memory()
        return _message(rows, table.column("chunk")[0].as_py(), blobs)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The number of strings for each minimiser that a chunk asked for, in the order of its question."""
    parts = [unpack(x) for x in table.column("packed").to_pylist()]
    keys = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, _ in parts])
    distinct, which = np.unique(keys, return_inverse=True)
    sums = np.bincount(which, np.concatenate([c for _, c in parts]), minlength=len(distinct))[which]
    edges = np.cumsum([0, *(len(c) for _, c in parts)])
    # Only whether a minimiser is alone, shared or hot matters.
    kind = (sums > 1).astype(np.uint8) + (sums > HOT_STRINGS)
    packed = [pack(kind[a:b].astype(np.uint8)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "packed": pa.array(packed, pa.binary())})


def _in_order(answers: pa.Table) -> np.ndarray:
    blobs = answers.column("packed").to_pylist()
    order = np.argsort(answers.column("bucket").to_numpy(), kind="stable").tolist()
    return np.concatenate([unpack(blobs[i])[0] for i in order] or [np.zeros(0, np.uint8)])


def _send(window: int, part: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _message([], 0, [])
        chunk = Chunk(table, window, part)
        words = chunk.words
        _, which, _ = chunk.minimisers()
        kind = _in_order(answers)[which] if len(which) else np.zeros(0, np.uint8)
        shared = kind > 0
        hot = np.unique(chunk.key[kind == 2])
        first, end, key = _alone(chunk.first[shared], chunk.end[shared], chunk.key[shared], words, window, hot)
        # The single windows stand behind the strings. Of each, a bucket gets one a chunk.
        strings = int((~np.isin(chunk.key[shared], hot)).sum())
        once, ranges = _once(chunk, first[strings:], end[strings:], window)
        sent = np.append(np.arange(strings), strings + np.flatnonzero(once))
        first, end, key = first[sent], end[sent], key[sent]
        decided = [np.concatenate(x) for x in zip(chunk.decided, ranges, strict=True)]
        bucket = _bucket_of(mixed(key), buckets)
        order = np.argsort(bucket, kind="stable")
        first, end, bucket = first[order], end[order], bucket[order]
        doc, text_key, start = chunk.places(first)
        opens, closes = words.starts[first].tolist(), words.ends[end - 1].tolist()
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = np.flatnonzero(np.diff(edges)).tolist()
        blobs = []
        for b in rows:
            sent = slice(edges[b], edges[b + 1])
            joined = b"\n".join([chunk.whole[x:y] for x, y in zip(opens[sent], closes[sent], strict=True)])
            blobs.append(pack(doc[sent], text_key[sent], start[sent], joined))
        number = table.column("chunk")[0].as_py()
        if len(decided[0]):  # negative buckets carry ranges that are already decided
            rows.append(-1 - number)
            blobs.append(pack(*decided))
        del chunk, words
        release_memory()
        return _message(rows, number, blobs)

    return run


def repeated_windows(doc, text_key, start, strings: bytes, window: int):
    """Word ranges covered by windows that occur earlier, among super-k-mers separated by line ends.

    Returns for each range the string's number, its document (two columns), and the first and end word.
    """
    data = np.frombuffer(strings, np.uint8)
    line_ends = np.flatnonzero(data == 10)
    words = split_words(data, np.concatenate([[0], line_ends + 1, [len(data)]]))
    counts = np.diff(words.bounds)
    order = _order(doc, text_key, start)
    windows = (counts - window + 1)[order]
    owner = np.repeat(order, windows)
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = words.bounds[owner] + inner
    hashes = range_hashes(words.hashes(), at, at + window, _WINDOW_BASE)
    sort = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[sort]
    opens = np.append(True, sorted_hashes[1:] != sorted_hashes[:-1])
    leader = sort[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    later = sort[~opens]
    leader = leader[~opens]
    place = start[owner] + inner
    same_place = (doc[owner[later]] == doc[owner[leader]]) & (text_key[owner[later]] == text_key[owner[leader]])
    same_place &= place[later] == place[leader]
    later, leader = later[~same_place], leader[~same_place]
    whole = words.buffer.tobytes()
    opens, closes = words.starts[at], words.ends[at + window - 1]
    equal = [
        whole[a:b] == whole[c:d]
        for a, b, c, d in zip(*(x.tolist() for x in (opens[later], closes[later], opens[leader], closes[leader])), strict=True)
    ]
    repeated = np.zeros(len(at), bool)
    repeated[later] = equal
    if not all(equal):  # different words with one hash: decide these windows by the words alone
        clashing = np.isin(hashes, hashes[later[~np.array(equal)]])
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(clashing).tolist():
            j = seen.setdefault(whole[opens[i] : closes[i]], i)
            repeated[i] = (doc[owner[i]], text_key[owner[i]], place[i]) != (doc[owner[j]], text_key[owner[j]], place[j])
    # Neighbouring repeated windows of one string make one range.
    begins = repeated.copy()
    begins[1:] &= ~repeated[:-1] | (owner[1:] != owner[:-1])
    stops = repeated.copy()
    stops[:-1] &= ~repeated[1:] | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(stops)
    found = owner[a]
    return found, doc[found], text_key[found], place[a].astype(np.int32), (place[b] + window).astype(np.int32)


def _meet(window: int):
    def run(group: pa.Table) -> pa.Table:
        bucket, chunks = group.column("bucket")[0].as_py(), group.column("chunk").to_numpy()
        if bucket < 0:
            return _message([bucket] * len(chunks), int(chunks[0]), group.column("packed").to_pylist())
        parts = list(zip(*(unpack(x) for x in group.column("packed").to_pylist()), strict=True))
        doc, text_key, start = (np.concatenate(p) for p in parts[:3])
        owner, *found = repeated_windows(doc, text_key, start, b"\n".join(parts[3]), window)
        chunk = np.repeat(chunks, [len(p) for p in parts[0]])[owner]
        order = np.argsort(chunk, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
        blobs = [pack(*(x[order[a:b]] for x in found)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rows = pa.array(chunk[order[cuts[:-1]]], pa.int64())
        return pa.table({"bucket": pa.array([bucket] * len(blobs), pa.int64()), "chunk": rows, "packed": pa.array(blobs, pa.binary())})

    return run


def _finish(with_text: bool, carried: int):
    def run(table: pa.Table, ranges: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        places = list(zip(table.column("doc").to_pylist(), table.column("text_key").to_pylist(), strict=True))
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for blob in ranges.column("packed").to_pylist():
            for doc, text_key, a, b in zip(*(x.tolist() for x in unpack(blob)), strict=True):
                found.setdefault((doc, text_key), []).append((a, b))
        n_words, n_removed, kept_texts, digests = [], [], [], []
        for place, text in zip(places, texts, strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            total = len(words)
            if place in found:
                steps = np.zeros(total + 1, np.int32)
                a, b = np.array(found[place]).T
                np.add.at(steps, a, 1)
                np.add.at(steps, b, -1)
                words = [w for w, depth in zip(words, np.cumsum(steps[:-1]).tolist(), strict=True) if not depth]
            kept = b" ".join(words)
            n_words.append(total)
            n_removed.append(total - len(words))
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(text if len(words) == total else kept.decode("utf-8", "surrogatepass"))
        columns = {
            "doc_id": table.column("doc_id"),
            "text_key": table.column("text_key"),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        if with_text:
            columns["kept_text"] = pa.array(kept_texts, pa.string())
        for k in range(carried):
            columns[f"carried_{k}"] = table.column(f"carried_{k}")
        release_memory()
        return pa.table(columns)

    return run


def dedup(
    documents: DataFrame,
    window: int = WINDOW,
    part: int = MINIMISER_WORDS,
    with_text: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Documents without repeated windows: ``doc_id``, ``text_key`` (hash of the text), ``n_words``, ``n_removed``,
    ``kept_sha256`` (of the kept words) and, if asked for, ``kept_text``: the text itself if nothing was removed,
    else the kept words. Columns named in ``carry`` follow.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(8, -(-size // CHUNK_BYTES))
    dealt = documents.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64("text").alias("text_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        *(F.col(name).alias(f"carried_{k}") for k, name in enumerate(carry)),
    )
    in_chunks = dealt.groupBy("chunk")
    asked = in_chunks.applyInArrow(_ask(window, part, chunks), _MESSAGE)
    answered = asked.groupBy("bucket").applyInArrow(_answer, _MESSAGE)
    sent = in_chunks.cogroup(answered.groupBy("chunk")).applyInArrow(_send(window, part, chunks), _MESSAGE)
    met = sent.groupBy("bucket").applyInArrow(_meet(window), _MESSAGE)
    schema = "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string"
    kinds = dict(documents.dtypes)
    schema += (", kept_text string" if with_text else "") + "".join(f", carried_{k} {kinds[c]}" for k, c in enumerate(carry))
    kept = in_chunks.cogroup(met.groupBy("chunk")).applyInArrow(_finish(with_text, len(carry)), schema)
    return kept.withColumnsRenamed({f"carried_{k}": name for k, name in enumerate(carry)})
