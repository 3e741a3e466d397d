"""Phrase collocations by relational mining: occurrence relations joined with themselves, one word longer each time.

The texts of a language are dealt into chunks. A chunk's occurrence relation lists what occurs at each position of its
pieces, in order; it is written to the shared folder. For each length the relation's groups are counted over all chunks,
groups that are too rare are semi-joined away, and what is left is merge-joined with itself by piece and adjacent
position: two occurrences of ``k`` words that overlap in all but their ends make one of ``k + 1``. A word or phrase is a
number from the first count on, so the relations stay small and no phrase is told from another by a hash.

A piece never crosses chunks, and a chunk sends a count for each distinct phrase, so neither a frequent word nor a hot
language or source meets in one task. Memory follows the chunk (``CHUNK_BYTES``); a single piece that is longer than
that is a chunk of its own. What a chunk lists is stored in rows of bounded size, and the stored tables in pages and row
groups of bounded size, so what a task holds does not follow the number of chunks it handles.

Definitions: A-Z are lowered; ``[.,;:!?\\x0A-\\x0D]`` end a piece, blanks and tabs a word. A null text is empty, a null
language is ``und``. Repeated rows, and rows that share an id, count as often as they occur. Other columns are ignored.
Tables without a frequent phrase give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .packing import pack, unpack
from .tokens import LOWER, release_memory

CHUNK_BYTES = 8 << 20
MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
INSIDE_PERCENT = 50
# Positions, and words or pairs, of a chunk that one stored row holds.
ROW_POSITIONS = 1 << 17
ROW_ITEMS = 1 << 15
# Rows are large: the writer looks at its sizes after a few, where it would gather a hundred first.
STORED = {
    "parquet.block.size": str(2 << 20),
    "parquet.page.size.row.check.min": "4",
    "parquet.page.size.row.check.max": "1000",
}
# Answers to chunks that a task packs at a time.
MARKS_AT_ONCE = 1 << 20
# The best phrases of a language are chosen in this many parts first.
RANKING_PARTS = 64

_WORD, _BLANK, _BREAK = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[32, 9]] = _BLANK
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK

_ITEM = pa.struct([("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])
_WORDS = pa.struct([("word", pa.string()), ("n", pa.int64())])
_CHUNK = [("chunk", pa.int64()), ("part", pa.int64()), ("codes", pa.binary())]
_FIRST = pa.schema([*_CHUNK, ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(_WORDS))])
_LONGER = pa.schema([*_CHUNK, ("pairs", pa.list_(_ITEM))])


def _stored(schema: pa.Schema, first: dict[str, object], codes: np.ndarray, items: pa.StructArray) -> Iterator[pa.RecordBatch]:
    """A chunk as rows of bounded size: its codes in parts, then its items in parts; ``part`` is the place of the first one.

    ``first`` is what the first row has besides; all rows have its ``chunk`` and ``lang``.
    """
    whole, listed = {f.name: first.get(f.name) for f in schema}, schema.names[-1]

    def row(part: int, packed: bytes | None, some: pa.StructArray | None) -> pa.RecordBatch:
        nonlocal whole
        offsets = pa.array([0, 0 if some is None else len(some)], pa.int32())
        lists = pa.nulls(1, schema.field(listed).type) if some is None else pa.ListArray.from_arrays(offsets, some)
        values = whole | {"part": part, "codes": packed}
        columns = [lists if f.name == listed else pa.array([values[f.name]], f.type) for f in schema]
        whole = {name: value if name in ("chunk", "lang") else None for name, value in whole.items()}
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for low in range(0, len(codes), ROW_POSITIONS):
        yield row(low, pack(codes[low : low + ROW_POSITIONS]), None)
    for low in range(0, len(items), ROW_ITEMS):
        yield row(low, None, items[low : low + ROW_ITEMS])


def stretches(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Cut text behind piece ends into parts of about ``limit`` bytes."""
    low = 0
    while len(data) - low > limit:
        breaks = np.flatnonzero(_KINDS[data[low : low + limit]] == _BREAK)
        if len(breaks):
            high = low + int(breaks[-1]) + 1
        else:
            beyond = np.flatnonzero(_KINDS[data[low + limit :]] == _BREAK)
            high = low + limit + int(beyond[0]) + 1 if len(beyond) else len(data)
        yield data[low:high]
        low = high
    yield data[low:]


def positions(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and the place of each word in that list, with -1 between pieces."""
    kinds = _KINDS[data]
    word = kinds == _WORD
    edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    del edge
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = LOWER[data[word]]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kinds == _BREAK), starts)
    place = np.arange(len(starts))
    place[1:] += np.cumsum(piece[1:] != piece[:-1])
    codes = np.full(place[-1] + 1, -1, np.int32)
    codes[place] = words.indices.to_numpy()
    return words.dictionary, codes


def _occurrences(chunk_bytes: int):
    """Rows of texts to rows for each chunk: its distinct words with counts, and the word at each position."""

    def chunk(lang: str, texts: list[bytes], number: Iterator[int]) -> Iterator[pa.RecordBatch]:
        for data in stretches(np.frombuffer(b"\n".join(texts), np.uint8), chunk_bytes):
            words, codes = positions(data)
            if len(codes):
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                items = pa.StructArray.from_arrays([words, pa.array(counts, pa.int64())], fields=list(_WORDS))
                first = {"chunk": next(number), "lang": lang, "n_words": int(counts.sum())}
                yield from _stored(_FIRST, first, codes, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number = iter(range(first, first + (1 << 32)))
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary())
            for lang, text in zip(langs, texts, strict=True):
                waiting.setdefault(lang, []).append(text.as_py())
                sizes[lang] = sizes.get(lang, 0) + len(waiting[lang][-1]) + 1
                # Whatever the number of languages, at most three chunks wait.
                while sizes[lang] >= chunk_bytes or sum(sizes.values()) >= 3 * chunk_bytes:
                    full = max(sizes, key=sizes.get)
                    del sizes[full]
                    yield from chunk(full, waiting.pop(full), number)
                    if full == lang:
                        break
        for lang, texts in waiting.items():
            yield from chunk(lang, texts, number)
        release_memory()

    return run


def _longer(relation: pa.Table, frequent: pa.Table) -> pa.Table:
    """Semi-join a chunk's relation with the groups that are frequent, then join it with itself at the next position.

    ``frequent`` holds, packed, which of the chunk's distinct phrases are frequent, and their numbers.
    """
    empty = _LONGER.empty_table()
    if not len(relation) or not len(frequent):
        return empty
    codes = np.concatenate([unpack(part)[0] for part in relation.sort_by("part").column("codes").to_pylist()])
    ids = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)  # the last one is what -1 reads
    for marks in frequent.column("marks").to_pylist():
        pos, numbers = unpack(marks)
        ids[pos] = numbers
    kept = np.where(ids[codes] >= 0, codes, -1).astype(np.int64)
    at = np.flatnonzero((kept[:-1] >= 0) & (kept[1:] >= 0))
    if not len(at):
        return empty
    pairs, place, counts = np.unique(kept[at] * len(ids) + kept[at + 1], return_inverse=True, return_counts=True)
    joined = np.full(len(codes), -1, np.int32)
    joined[at] = place
    left, right = ids[pairs // len(ids)], ids[pairs % len(ids)]
    items = pa.StructArray.from_arrays([pa.array(left), pa.array(right), pa.array(counts, pa.int64())], fields=list(_ITEM))
    return pa.Table.from_batches(_stored(_LONGER, {"chunk": relation.column("chunk")[0].as_py()}, joined, items), _LONGER)


def _answers(keys: list[tuple[str, pa.DataType]]):
    """Rows of frequent phrases to one row for each phrase, and packed rows that tell each chunk its phrases' numbers."""
    schema = pa.schema([*keys, ("f", pa.int64()), ("id", pa.int64()), ("asker", pa.int64()), ("marks", pa.binary())])

    def filled(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        chunk, pos, ids = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((pos, chunk))
        chunk, pos, ids = chunk[order], pos[order], ids[order]
        starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        marks = [pack(p, i) for p, i in zip(np.split(pos, starts[1:]), np.split(ids, starts[1:]), strict=True)]
        return filled({"asker": pa.array(chunk[starts]), "marks": pa.array(marks, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            first = pc.equal(column("row"), column("id"))
            yield filled({n: column(n).filter(first) for n in (*(k for k, _ in keys), "f", "id")})
            waiting.append(tuple(column(n).to_numpy() for n in ("chunk", "pos", "id")))
            size += len(batch)
            if size >= MARKS_AT_ONCE:
                yield packed(waiting)
                waiting, size = [], 0
        if size:
            yield packed(waiting)

    return run


def _frequent(occurring: DataFrame, keys: list[str], min_count: int) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases (``keys``, count ``f``, number ``id``), and for each chunk the numbers of those it has.

    ``occurring`` has one row for each chunk and phrase, with ``n`` occurrences. One shuffle serves the count and the
    semi-join: the rows of a phrase, at most one a chunk, meet in a window. The answers are packed and written, so
    that the numbers stay.
    """
    same = Window.partitionBy(*keys)
    rows = occurring.repartition(*keys).withColumn("row", F.monotonically_increasing_id())
    counted = rows.withColumns({"f": F.sum("n").over(same), "id": F.min("row").over(same)})
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    types = [(k, kinds[occurring.schema[k].dataType.simpleString()]) for k in keys]
    schema = ", ".join(f"{k} {occurring.schema[k].dataType.simpleString()}" for k in keys)
    answers = counted.filter(F.col("f") >= min_count).drop("n").mapInArrow(
        _answers(types), f"{schema}, f long, id long, asker long, marks binary"
    )
    answers = cut_lineage(answers, "frequent", **STORED)
    return answers.filter("id IS NOT NULL").drop("asker", "marks"), answers.filter("asker IS NOT NULL").select("asker", "marks")


def frequent_phrases(
    documents: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, chunk_bytes: int = CHUNK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``max_words`` words with ``min_count`` occurrences, and the words of each language.

    Columns: ``lang``, ``phrase``, ``n_words`` (of the phrase), ``f``; and ``lang``, ``n``.
    """

    def listed(relation: DataFrame, items: str, *keys: str) -> DataFrame:
        rows = relation.filter(F.col(items).isNotNull()).select("chunk", "part", *keys, F.posexplode(items).alias("at", "col"))
        return rows.withColumn("pos", (F.col("part") + F.col("at")).cast("int"))

    texts = documents.filter(F.octet_length("text") > 0).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    relation = cut_lineage(
        texts.mapInArrow(
            _occurrences(chunk_bytes),
            "chunk long, part long, codes binary, lang string, n_words long, words array<struct<word:string,n:long>>",
        ),
        "occurrences",
        **STORED,
    )
    totals = relation.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = listed(relation, "words", "lang").select("chunk", "pos", "lang", "col.word", "col.n")
    groups, marks = _frequent(words, ["lang", "word"], min_count)
    known = groups.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    phrases = known.withColumn("n_words", F.lit(1))
    for size in range(2, max_words + 1):
        placed = relation.filter("codes IS NOT NULL").select("chunk", "part", "codes")
        relation = cut_lineage(
            placed.groupBy("chunk").cogroup(marks.groupBy("asker")).applyInArrow(
                _longer, "chunk long, part long, codes binary, pairs array<struct<left:long,right:long,n:long>>"
            ),
            "occurrences",
            **STORED,
        )
        pairs = listed(relation, "pairs").select("chunk", "pos", "col.left", "col.right", "col.n")
        groups, marks = _frequent(pairs, ["left", "right"], min_count)
        heads = known.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"))
        tails = known.select(F.col("id").alias("right"), "last")
        named = groups.join(heads, "left").join(tails, "right")
        known = cut_lineage(named.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f"), "phrases")
        phrases = phrases.unionByName(known.withColumn("n_words", F.lit(size)))
    return phrases.select("lang", "phrase", "n_words", "f"), totals


def _parts(column: str) -> str:
    cut = "named_struct('k', k, 'first', array_join(slice({0}, 1, k), ' '), 'rest', array_join(slice({0}, k + 1, size({0}) - k), ' '))"
    return f"transform(sequence(1, size({column}) - 1), k -> {cut.format(column)})"


def _shorter(column: str) -> str:
    of_size = "transform(sequence(1, size({0}) - m + 1), s -> array_join(slice({0}, s, m), ' '))".format(column)
    return f"array_distinct(flatten(transform(sequence(2, size({column}) - 1), m -> {of_size})))"


def collocations(
    documents: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    inside_percent: int = INSIDE_PERCENT,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The ``top`` phrases of each language by how strongly their parts attract each other.

    A candidate of ``a`` occurrences, cut into parts of ``l`` and ``r``, scores ``floor(1000000 a a / (l r))`` at its
    weakest cut (the earliest of equal ones). It is dropped if a longer candidate holds it and has at least
    ``inside_percent`` percent of its occurrences. Columns: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``
    (words of the language), ``score``; ties go to the larger ``a``, then to the phrase in byte order.
    """
    if max_words < 2:
        raise ValueError("a collocation has at least two words")
    phrases, totals = frequent_phrases(documents, max_words, min_count, chunk_bytes)
    words = F.split("phrase", " ")
    candidates = phrases.filter("n_words >= 2").select("lang", "phrase", words.alias("w"), F.col("f").alias("a"))

    cuts = candidates.select("lang", "phrase", "a", F.inline(F.expr(_parts("w"))))
    firsts = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = [f"CAST({c} AS DECIMAL(18, 0))" for c in ("a", "l", "r")]
    score = F.expr("(1000000 * ({0} * {0})) div ({1} * {2})".format(*exact))
    scored = (
        cuts.join(firsts, ["lang", "first"])
        .join(rests, ["lang", "rest"])
        .withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    longest = (
        candidates.filter(F.size("w") >= 3)
        .select("lang", F.explode(F.expr(_shorter("w"))).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    kept = scored.join(longest, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))
    )
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKING_PARTS))
    best = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
    best = best.filter(F.col("_rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
