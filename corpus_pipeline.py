"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes the documents that the one before it kept and returns a DataFrame, which is written to the shared folder
and read again. All but the last return the columns of ``documents``.

1. ``language_id``: documents in which no known language is recognised go. The classifier learns from the labelled rows.
2. ``minhash_dedup``: of documents that are near copies of each other the one with the smallest id stays. Rows that repeat
   an id, or have none, are judged by their own texts; of identical rows one stays.
3. ``substring_dedup``: words covered by a run of 20 words that occurs earlier are removed from the text, and ``n_chars``
   follows. A document of which nothing is left stays with an empty text; other documents keep their text as it is.
4. ``decontaminate``: documents with a benchmark passage go.
5. ``bpe``: texts become token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.llm import bpe, decontaminate, language_id, minhash_dedup, substring_dedup
from tallyman.llm.shared import prepared, table
from tallyman.session import cut_lineage

VOCABULARY = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return language_id.accepted(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    keyed = docs.withColumn("_row", F.col("doc_id"))
    if not docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        # Rows are told apart by their place in the order of ids and texts instead.
        ordered = docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
        keyed = cut_lineage(ordered.withColumn("_row", F.monotonically_increasing_id()), "rows")
    rows = minhash_dedup.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"))
    copies = rows.filter("NOT kept").select(F.col("doc_id").alias("_row"))
    return keyed.join(copies, "_row", "left_anti").select(docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    kept = substring_dedup.dedup(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    changed = F.col("n_removed") > 0
    kept = kept.withColumn("n_chars", F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return kept.withColumnRenamed("kept_text", "text").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

# The stages learn, hash and tokenise; SQL cannot express them. They are tested against plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
