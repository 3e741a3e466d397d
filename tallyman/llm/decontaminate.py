"""Benchmark decontamination: words of a document inside any run of words that a benchmark item also has.

All windows of the benchmark go into one Aho-Corasick automaton, with which each normalised text is scanned once. Word
positions lead back to character offsets in the original text.

Spark makes the windows. The automaton has at most one node for each byte of them, so its size is bounded by cutting the
windows into blocks of about ``block_bytes`` by their hash; the bound holds for any benchmark. One block at a time is
collected, broadcast, scanned with and given up; the hits of each are written to the shared folder and merged by document.
A usual benchmark is one block and one scan.

Definitions: words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. An item with fewer words
than a window is one window; items and documents that are null or without words have none. Rows that repeat an item id
count as one item; an item without id is named ``null``. Every document row gives one row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

WINDOW = 10
# Bytes of windows and item ids in a block; an automaton takes up to about 50 times as much in each Python worker.
BLOCK_BYTES = 6 << 20

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of each item: ``key`` (words joined by blanks, a character a byte), ``size`` and ``item``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                keys = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(sorted(keys), pa.binary()),
                        "size": pa.array([size] * len(keys), pa.int32()),
                        "item": pa.array([item] * len(keys), pa.string()),
                    }
                )

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return items.mapInArrow(run, "key binary, size int, item string").distinct()


def automaton_of(rows: list[tuple[bytes, int, str]]) -> ahocorasick.Automaton | None:
    """An automaton of windows, each with its number of words and the items that have it."""
    owners: dict[bytes, tuple[int, list[str]]] = {}
    for key, size, item in rows:
        owners.setdefault(key, (size, []))[1].append(item)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for key, (size, names) in owners.items():
        # One character a byte; blanks around a window keep it to whole words.
        automaton.add_word(f" {key.decode('latin-1')} ", (len(key) + 2, size, tuple(sorted(names))))
    automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges of all occurrences, in order and merged, and the items found."""
    line = f" {b' '.join(words).decode('latin-1')} "
    hits = [(end + 1 - length, size, names) for end, (length, size, names) in automaton.iter(line)]
    if not hits:
        return [], set()
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    ranges: list[tuple[int, int]] = []
    found: set[str] = set()
    for at, size, names in sorted((int(np.searchsorted(blanks, at)), size, names) for at, size, names in hits):
        found.update(names)
        if ranges and at <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], at + size))
        else:
            ranges.append((at, at + size))
    return ranges, found


# The automaton of the block that this worker process scans with.
_current: dict[str, ahocorasick.Automaton | None] = {}


def _automaton(shared, block: str) -> ahocorasick.Automaton | None:
    if block not in _current:
        _current.clear()
        _current[block] = automaton_of(shared.value)
    return _current[block]


_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
_FOUND = (
    "row long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>, spans array<struct<from:int,to:int>>"
)


def _scanner(shared, block: str, everything: bool):
    """Hits of each row: ranges of words and of characters, and items. Rows without hits only if ``everything`` is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, block)
        for batch in batches:
            kept, n_words, starts, ends, items, spans = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                ranges, found = scan(automaton, words) if automaton and words else ([], set())
                if not (ranges or everything):
                    continue
                places = [m.span() for m in _WORD.finditer(text)] if ranges else []
                kept.append(i)
                n_words.append(len(words))
                starts.append([a for a, _ in ranges])
                ends.append([b for _, b in ranges])
                items.append(sorted(found))
                spans.append([{"from": places[a][0], "to": places[b - 1][1]} for a, b in ranges])
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column(0).take(rows),
                    "doc_id": batch.column(1).take(rows),
                    "n_words": pa.array(n_words, pa.int64()),
                    "starts": pa.array(starts, pa.list_(pa.int32())),
                    "ends": pa.array(ends, pa.list_(pa.int32())),
                    "items": pa.array(items, pa.list_(pa.string())),
                    "spans": pa.array(spans, _SPANS),
                }
            )

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the ranges and items that the blocks have found in a document."""
    for batch in batches:
        at = batch.schema.get_field_index
        n_hit, digests, counts, all_items, all_spans = [], [], [], [], []
        for starts, ends, items, spans in zip(*(batch.column(at(n)).to_pylist() for n in ("starts", "ends", "items", "spans")), strict=True):
            merged: list[list[int]] = []
            for a, b, span in sorted(zip(starts, ends, ((s["from"], s["to"]) for s in spans), strict=True)):
                if merged and a <= merged[-1][1]:
                    if b > merged[-1][1]:
                        merged[-1][1], merged[-1][3] = b, span[1]
                else:
                    merged.append([a, b, *span])
            names = sorted(set(items))
            n_hit.append(sum(b - a for a, b, _, _ in merged))
            counts.append(len(names))
            digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            all_items.append(names)
            all_spans.append([{"from": low, "to": high} for _, _, low, high in merged])
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(at("doc_id")),
                "n_words": batch.column(at("n_words")),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array(counts, pa.int64()),
                "items_sha256": pa.array(digests, pa.string()),
                "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
                "items": pa.array(all_items, pa.list_(pa.string())),
                "spans": pa.array(all_spans, _SPANS),
            }
        )


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, Iterator]:
    """The number of blocks, and their windows as broadcasts, made one after the other."""
    rows = cut_lineage(windows(benchmark, window), "windows")
    size = rows.agg(F.sum(F.octet_length("key") + F.octet_length("item") + 2)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def each() -> Iterator:
        for block in range(blocks):
            part = rows.filter(F.pmod(F.xxhash64("key", "item"), F.lit(blocks)) == block)
            yield benchmark.sparkSession.sparkContext.broadcast([(bytes(r["key"]), r["size"], r["item"]) for r in part.collect()])

    return blocks, each()


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Counts, items and character spans (``from``, ``to`` in the original text) of benchmark passages.

    Columns: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (of the ids, sorted and joined by
    commas), ``contaminated``, ``items`` and ``spans``.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks, parts = _blocks(benchmark, window, block_bytes)
    if blocks == 1:
        found = rows.mapInArrow(_scanner(next(parts), uuid.uuid4().hex, True), _FOUND)
    else:
        rows = cut_lineage(rows, "rows")  # their numbers are kept over all scans
        scans = []
        for shared in parts:
            scans.append(cut_lineage(rows.mapInArrow(_scanner(shared, uuid.uuid4().hex, not scans), _FOUND), "hits"))
            shared.destroy()
        found = scans[0]
        for more in scans[1:]:
            found = found.unionByName(more)
        together = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *map(together, ("starts", "ends", "items", "spans"))
        )
    return found.mapInArrow(
        _report,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, "
        "spans array<struct<from:int,to:int>>",
    )


def _clean(shared, block: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, block)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lines = (f" {b' '.join(words_of(t)).decode('latin-1')} " for t in texts)
            clean = [automaton is None or next(automaton.iter(line), None) is None for line in lines]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark passage, with all their columns."""
    blocks, parts = _blocks(benchmark, window, block_bytes)
    for shared in parts:
        documents = documents.mapInArrow(_clean(shared, uuid.uuid4().hex), documents.schema)
        if blocks > 1:
            documents = cut_lineage(documents, "clean")
            shared.destroy()
    return documents
