"""MinHash near-dedup: circulant signatures, banding, and Jaccard verification on whole shingle sets.

Two permutations of the shingle universe make a whole signature: the first scatters a shingle, and coordinate ``k``
is the smallest value of the second over the scattered set shifted circularly by ``k`` steps. Rows of a band with
equal coordinates share a bucket.

Links between different texts are looked for without pairing the members of a bucket with each other:

1. texts with the same shingle set form one class, of which only the smallest document goes on;
2. every class is compared with the smallest class of each of its buckets, and the confirmed pairs are joined into
   components;
3. only buckets that still hold more than one component matter. Their members in different components are compared,
   after a long sketch, made for these members alone, has ruled out those that are clearly below the threshold.

Definitions: null texts and texts without words have no shingles and link with nothing, nor do rows without an id. Every
row is returned. Ids are taken to be unique; if rows repeat an id, links are confirmed on its smallest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import components, lookup_join
from .tokens import LOWER, LOWER_WORDS, mixed, range_hashes, release_memory, split_words, text_blocks

SHINGLE = 5
BANDS = 20
BAND_ROWS = 4
# Coordinates of the long sketch, of which four bits each are kept, 16 in an integer.
LONG_SKETCH = 512
# A pair is verified unless its sketches differ by so many deviations more than at the threshold.
DEVIATIONS = 4.5

SKETCH_SCHEMA = "doc_id long, n_shingles long, set_1 long, set_2 long, bands array<long>"


def _second_permutation(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def circulant_signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """``coordinates`` MinHash values of a non-empty set of 64-bit shingle hashes.

    The hash's upper half is the first permutation's value; a shift by one step is an odd constant modulo 2**32, so
    all shifts differ.
    """
    scattered = (shingles >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32) * np.uint32(0x9E3779B1)
    low = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    step = max(64, (1 << 17) // coordinates)
    for at in range(0, len(scattered), step):
        part = scattered[None, at : at + step] + shifts[:, None]
        np.minimum(low, _second_permutation(part).min(axis=1), out=low)
    return low


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words; with fewer words, of the whole sequence."""
    count = max(1, len(words) - size + 1)
    starts = np.arange(count)
    return np.unique(range_hashes(words, starts, np.minimum(starts + size, len(words))))


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch, "text"):
                words = split_words(data, offsets, LOWER_WORDS)
                hashes = words.hashes()
                counts, sets, banded = [], [], []
                for start, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                    if start == end:
                        counts.append(0)
                        sets.append((0, 0))
                        banded.append(None)
                        continue
                    shingles = _shingles(hashes[start:end], size)
                    signature = circulant_signature(shingles, bands * rows)
                    counts.append(len(shingles))
                    sets.append((np.bitwise_xor.reduce(mixed(shingles)), np.bitwise_xor.reduce(mixed(shingles * shingles))))
                    keys = signature.reshape(bands, rows).astype(np.uint64)
                    key = np.arange(bands, dtype=np.uint64)
                    for column in keys.T:
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
                    banded.append(key.view(np.int64))
                digests = np.array(sets, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index("doc_id")).slice(low, high - low).cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.array(banded, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_1", "set_2", "bands"],
                )
        release_memory()

    return run


def sketch(documents: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """Shingle count, a 128-bit digest of the shingle set and band keys of each document."""
    return documents.select("doc_id", "text").mapInArrow(_sketches(size, bands, rows), SKETCH_SCHEMA)


def shingle_set(text: str, size: int = SHINGLE) -> set[bytes]:
    words = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _confirm(size: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found, last, against = [], None, set()
            for mine, other, b in zip(frame["text_a"], frame["text_b"], frame["b"], strict=True):
                if b != last:
                    last, against = b, shingle_set(other, size)
                own = shingle_set(mine, size)
                common = len(own & against)
                found.append(100 * common >= percent * (len(own) + len(against) - common))
            yield frame.loc[found, ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose whole shingle sets are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(_confirm(size, percent), "a long, b long")


def _long_sketches(size: int):
    columns = LONG_SKETCH // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch, "text"):
                words = split_words(data, offsets, LOWER_WORDS)
                hashes = words.hashes()
                packed = np.zeros((high - low, columns), np.int64)
                for i, (start, end) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
                    signature = circulant_signature(_shingles(hashes[start:end], size), LONG_SKETCH)
                    nibbles = (signature & 15).astype(np.uint8).reshape(-1, 2)
                    packed[i] = (nibbles[:, 0] << 4 | nibbles[:, 1]).view(np.int64)
                ids = batch.column(batch.schema.get_field_index("doc_id")).slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(packed[:, k]) for k in range(columns))],
                    names=["class_id", *(f"part_{k}" for k in range(columns))],
                )

    return run


def long_sketches(texts: DataFrame, size: int) -> DataFrame:
    parts = ", ".join(f"part_{k} long" for k in range(LONG_SKETCH // 16))
    return texts.select("doc_id", "text").mapInArrow(_long_sketches(size), f"class_id long, {parts}")


def _meet_first(bands: int) -> Column:
    """Whether two members share no bucket of an earlier band, so that each pair is looked at once."""
    earlier = F.lit(False)
    for k in range(bands - 1):
        earlier = earlier | ((F.col("x.band") > k) & (F.col(f"x.key_{k}") == F.col(f"y.key_{k}")))
    return ~earlier


def _may_link(percent: int) -> Column:
    """Whether two long sketches differ in few enough coordinates."""
    differ = F.lit(0)
    for k in range(LONG_SKETCH // 16):
        bits = F.col(f"x.part_{k}").bitwiseXOR(F.col(f"y.part_{k}"))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(bits)
    share = (100 - percent) / 100 * 15 / 16
    allowed = LONG_SKETCH * share + DEVIATIONS * np.sqrt(LONG_SKETCH * share * (1 - share))
    return differ <= int(np.ceil(allowed))


def near_duplicates(
    documents: DataFrame, percent: int = 80, size: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS
) -> DataFrame:
    """Component of each document: columns ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets.
    """
    sketched = cut_lineage(sketch(documents, size, bands, rows), "sketches")
    total = max(1, sketched.count())
    whole_set = ["n_shingles", "set_1", "set_2"]
    filled = sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    keyed = filled.withColumn("set_key", F.struct(*whole_set))
    classes = cut_lineage(
        keyed.groupBy("set_key").agg(
            F.min("doc_id").alias("class_id"), F.count("*").alias("n_rows"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    members = classes.select("class_id", F.posexplode("bands").alias("band", "key"))
    members = cut_lineage(members.select(F.xxhash64("band", "key").alias("bucket"), "band", "class_id"), "members")
    buckets = members.groupBy("bucket").agg(F.min("class_id").alias("first_id"), F.count("*").alias("n_rows"))
    starred = cut_lineage(lookup_join(members, buckets.filter("n_rows > 1"), "bucket", total), "stars")
    pairs = starred.filter("class_id != first_id").select(F.col("class_id").alias("a"), F.col("first_id").alias("b"))
    pairs = cut_lineage(pairs.distinct(), "pairs")
    wanted = starred.select(F.col("class_id").alias("doc_id")).distinct()
    texts = documents.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    texts = cut_lineage(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "candidates")
    links = cut_lineage(confirmed(pairs, texts, size, percent), "confirmed")

    groups = components(links).withColumnRenamed("id", "class_id")
    labelled = starred.select("bucket", "band", "class_id").join(groups, "class_id", "left")
    labelled = cut_lineage(labelled.withColumn("component", F.coalesce("component", "class_id")), "labelled")
    split = labelled.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_rows")
    )
    open_buckets = split.filter("low != high").drop("high", "low")
    rest = cut_lineage(lookup_join(labelled, open_buckets, "bucket", total), "open")
    involved = rest.select(F.col("class_id").alias("doc_id")).distinct()
    sketches = cut_lineage(long_sketches(texts.join(involved, "doc_id", "left_semi"), size), "sketches")
    keys = classes.select("class_id", *(F.col("bands")[k].alias(f"key_{k}") for k in range(bands - 1)))
    rest = cut_lineage(rest.join(sketches.join(keys, "class_id"), "class_id"), "open")
    here, there = rest.alias("x"), rest.alias("y")
    met = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") > F.col("y.component"))
    met = met & _meet_first(bands) & _may_link(percent)
    crossing = here.join(there, met).select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"))
    tried = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    crossing = cut_lineage(crossing.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = confirmed(crossing, texts, size, percent)
    found = components(links.unionByName(more)).withColumnRenamed("id", "class_id")
    resolved = classes.join(found, "class_id", "left").select(
        "set_key", F.coalesce("component", "class_id").alias("component_id"), "n_rows"
    )
    grouped = lookup_join(keyed.select("doc_id", "n_shingles", "set_key"), resolved, "set_key", total).drop("set_key")
    alone = sketched.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
