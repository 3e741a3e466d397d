"""What the operators of this subpackage share: tables, row identity, joins that survive hot keys, components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, cut_lineage

# A key with more than this share of all rows is hot; so there are never more hot keys than its inverse.
HOT_SHARE = 1 / 2000


# Rows and bytes that a Python worker is given at a time.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Let Spark send this package to the Python workers, unless PYTHONPATH tells them where it is."""
    package = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if package.parent in on_path or context.applicationId in _shipped:
        return
    # The driver serves the archive to the executors; only the driver reads this file.
    archive = Path(tempfile.mkdtemp(prefix="tallyman-")) / "tallyman_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings, bound the batches that Python workers get, and send them this package."""
    _ship(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves ``part``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row for each key and the key's frequency ``n_rows``.

    Keys with more than ``HOT_SHARE`` of the ``total`` rows are at most ``1 / HOT_SHARE``, whatever the size of
    the data; only their entries are broadcast. All others are joined by a shuffle without a large key.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = lookup.filter(F.col("n_rows") > limit).drop("n_rows")
    cold = lookup.filter(F.col("n_rows") <= limit).drop("n_rows")
    flagged = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    spread = flagged.filter(F.col("_hot").isNull()).drop("_hot").join(cold.hint("shuffle_merge"), key)
    return spread.unionByName(rows.join(F.broadcast(hot), key))


# Links that one task of a round takes; rounds have fewer and fewer.
LINKS_PER_TASK = 200_000


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each node that has an edge: columns ``id`` and ``component``.

    ``edges`` has the columns ``a`` and ``b``. Each round hangs the larger neighbours of every node below the
    smallest of its neighbours, then the smaller ones too, until nothing changes; long chains shorten by half.
    Rounds are written to the shared folder; the driver sees a count and a checksum of each.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    links = cut_lineage(links.distinct(), "links")
    state = _state(links)
    while state[0]:
        tasks = 1 + state[0] // LINKS_PER_TASK
        ends = links.select("a", "b", F.lit(0).alias("larger")).unionByName(
            links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("larger"))
        )
        lowest = ends.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.min("a")).alias("low"), F.sum("larger").alias("n_rows")
        )
        above = links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        hung = lookup_join(above, lowest, "node", state[0]).select(F.col("other").alias("a"), F.col("low").alias("b"))
        large = cut_lineage(hung.distinct().coalesce(tasks), "links")

        smallest = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n_rows"))
        pulled = lookup_join(large, smallest, "a", large.count())
        small = pulled.select(
            F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")
        )
        links = cut_lineage(small.distinct().coalesce(tasks), "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return roots.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
