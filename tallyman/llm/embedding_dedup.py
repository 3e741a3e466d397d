"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised, so their cosine gives their distance. A table hashes a vector by ``width``-quantised random
projections; vectors that agree in all projections of a table share a bucket, where their cosines are computed exactly.

The number of projections follows the number of vectors, so that unrelated vectors share a bucket with few others at any
size, and the number of tables follows from it so that a pair right at the threshold is found with probability
``recall``; closer pairs are found more surely.

Within a bucket links are counted, not written out. A pair that meets in several tables counts in the first of them,
which both vectors' hashes tell. Of each bucket only the number of new links of a vector and the smallest vector that it
is connected to go on. A bucket with more than ``BLOCK`` vectors is cut into blocks by hash, and each two blocks meet in
a task of their own. Equal vectors are one class and are compared once.

Definitions: vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id link with
nothing; so do vectors of different length. Ids are taken to be unique. Labels and other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import components, lookup_join

COSINE = 0.9
RECALL = 0.95
WIDTH = 1.2
BLOCK = 512
# Unrelated vectors that a bucket holds beside one, on average.
STRANGERS = 8
_SEED = 20240517


def collision_chance(distance: float, width: float) -> float:
    """Probability that one quantised projection of two vectors at this distance is equal."""
    ratio = width / distance
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def plan(vectors: int, cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Projections of a table and number of tables for so many vectors."""
    near = collision_chance(math.sqrt(2 - 2 * cosine), width)
    far = collision_chance(math.sqrt(2), width)
    projections = max(4, math.ceil(math.log(max(vectors, 2) / STRANGERS) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


class Hasher:
    """Bucket keys of normalised vectors, a column for each table."""

    def __init__(self, projections: int, tables: int, width: float):
        self.shape, self.width = (tables, projections), width
        self.directions: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        size = vectors.shape[1]
        if size not in self.directions:
            random = np.random.default_rng([_SEED, size])
            count = self.shape[0] * self.shape[1]
            self.directions[size] = random.normal(size=(size, count)), random.uniform(0, self.width, count)
        directions, shifts = self.directions[size]
        cells = np.floor((vectors @ directions + shifts) / self.width).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(vectors), *self.shape)
        key = np.broadcast_to(np.arange(self.shape[0], dtype=np.uint64), cells.shape[:2]) * np.uint64(0xD1342543DE82EF95) + np.uint64(size)
        for k in range(self.shape[1]):
            key = (key ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Normalised vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = flat.reshape(len(column), -1)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.sqrt((found * found).sum(axis=1, keepdims=True))


def _bucket(projections: int, tables: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(projections, tables, width)
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                keys = hasher.keys(_matrix(part.column(1)))
                edges = pa.array(np.arange(0, keys.size + 1, tables), pa.int32())
                lists = pa.ListArray.from_arrays(edges, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["class_id", "keys"])

    return run


def linked(vectors: np.ndarray, tables: np.ndarray, sides: np.ndarray, cosine: float, hasher: Hasher, table: int):
    """Pairs of a bucket that are close enough and meet in no earlier table.

    ``sides`` is 0 for all vectors of a whole bucket; of two blocks that meet, only pairs across are looked at.
    """
    close = np.triu(vectors @ vectors.T >= cosine, 1)
    if sides.any():
        close &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(close)
    if not len(a) or not table:
        return a, b
    involved = np.unique(np.concatenate([a, b]))
    keys = hasher.keys(vectors[involved])[:, :table]
    at = np.searchsorted(involved, a), np.searchsorted(involved, b)
    new = np.ones(len(a), bool)
    for low in range(0, len(a), 1 << 16):
        part = slice(low, low + (1 << 16))
        new[part] = ~(keys[at[0][part]] == keys[at[1][part]]).any(axis=1)
    return a, b, new


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of ``n`` places is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _compare(projections: int, tables: int, width: float, cosine: float):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy()
            # The batch's last group may go on in the next one.
            last = int(np.searchsorted(np.flatnonzero(keys != keys[-1]), len(keys)))
            start = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if last else 0
            if start:
                yield pa.Table.from_batches([*waiting, batch.slice(0, start)])
                waiting = [batch.slice(start)]
            elif waiting and waiting[-1].column(0)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(waiting)
                waiting = [batch]
            else:
                waiting.append(batch)
        if waiting:
            yield pa.Table.from_batches(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(projections, tables, width)
        for table in groups(batches):
            keys = table.column("meeting").to_numpy()
            number, side = table.column("table").to_numpy(), table.column("side").to_numpy()
            ids, copies = table.column("class_id").to_numpy(), table.column("copies").to_numpy()
            edges = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)), len(keys))
            column = table.column("embedding").combine_chunks()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                vectors = _matrix(column.slice(low, high - low))
                found = linked(vectors, number, side[low:high], cosine, hasher, int(number[low]))
                a, b = found[:2]
                if not len(a):
                    continue
                new = found[2] if len(found) == 3 else np.ones(len(a), bool)
                n, own = high - low, copies[low:high]
                links = np.bincount(a[new], own[b[new]], minlength=n) + np.bincount(b[new], own[a[new]], minlength=n)
                by_id = np.argsort(ids[low:high], kind="stable")
                place = np.empty(n, np.int64)
                place[by_id] = np.arange(n)
                root = by_id[_roots(n, place[a], place[b])[place]]
                some = np.unique(np.concatenate([a, b]))
                out.append((ids[low:high][some], links[some].astype(np.int64), ids[low:high][root[some]]))
            if out:
                columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["class_id", "links", "root"])

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH) -> DataFrame:
    """Links and components of all vectors: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    vector = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull()
        & vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    keyed = rows.filter("usable").select("vec_id", "embedding", F.xxhash64("embedding").alias("vector_hash"))
    classes = cut_lineage(
        keyed.groupBy("vector_hash", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")), "classes"
    )
    count = classes.count()
    projections, tables = plan(count, cosine, recall, width)
    hashed = classes.select("class_id", "embedding").mapInArrow(
        _bucket(projections, tables, width), "class_id long, keys array<long>"
    )
    members = cut_lineage(hashed.select("class_id", F.posexplode("keys").alias("table", "bucket")), "members")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n_rows")).withColumn("size", F.col("n_rows"))
    # Buckets are met once for each table; a bucket is hot if it has a large share of one table's rows.
    met = lookup_join(members, sizes.filter("n_rows > 1"), "bucket", count)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("meeting"),
        "table",
        F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"),
        F.col("class_id"),
    )
    vectors = classes.select("class_id", "copies", "embedding")
    compared = (
        met.join(vectors, "class_id")
        .select("meeting", "table", "side", "class_id", "copies", "embedding")
        .repartition("meeting")
        .sortWithinPartitions("meeting")
        .mapInArrow(_compare(projections, tables, width, cosine), "class_id long, links long, root long")
    )
    found = cut_lineage(compared, "found")
    groups = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    # The hash deals the rows, the vector itself tells them apart.
    vector_key = F.struct("vector_hash", "embedding").alias("vector_key")
    resolved = (
        classes.select(vector_key, "class_id", "copies")
        .join(links, "class_id", "left")
        .join(groups.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select(
            "vector_key",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
            F.col("copies").alias("n_rows"),
        )
    )
    joined = lookup_join(keyed.select("vec_id", vector_key), resolved, "vector_key", max(1, count)).drop("vector_key")
    alone = rows.filter(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
