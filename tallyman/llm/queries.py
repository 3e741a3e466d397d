"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat_format,
    collocations,
    conversation_repair,
    decontaminate,
    embedding_dedup,
    html_extract,
    language_id,
    license_scan,
    lm_score,
    minhash_dedup,
    oracles,
    substring_dedup,
    toxicity,
)
from .shared import held_out, prepared, table

WORD_BPE = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepared(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


@query("op1_substring_dedup", oracles.SUBSTRING_DEDUP)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False).drop("text_key")


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return bpe.encode_documents(documents, public_tokenizers.path(WORD_BPE), with_ids=False)


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    model = language_id.fit(documents.filter(~out))
    return language_id.predict(documents, model).withColumn("held_out", out)


@query("op4_license_scan", license_scan.oracle())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return lm_score.score(documents, ~held_out(F.col("doc_id"), 7, 2))


@query("op6_chat_format", chat_format.ORACLE)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.preference_samples(chat_format.neighbours(table(spark, sf_dir, "conversations")))


@query("op7_decontaminate", oracles.decontaminate())
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(documents, benchmark).drop("items")
    span = F.transform("spans", lambda s: F.concat_ws("-", s["from"], s["to"]))
    return found.withColumn("spans", F.array_join(span, ","))


@query("op8_embedding_dedup", oracles.EMBEDDING_DEDUP)
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    scorer = toxicity.fit(documents, labels.filter(~out))
    return toxicity.score(documents, scorer).withColumn("held_out", out)


@query("op10_minhash_dedup", oracles.MINHASH_DEDUP)
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op11_collocations", oracles.COLLOCATIONS)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair", oracles.CONVERSATION_REPAIR)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query("op13_html_extract")
def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))
