from __future__ import annotations

import corpus_pipeline
from tallyman.llm.shared import prepared
from tallyman.session import cut_lineage

from . import reference


def test_stages_decide_as_plain_python(spark, sf_dir):
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        kept = {r["doc_id"] for r in rows}
        if name == "language_id":
            assert kept == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "minhash_dedup":
            assert kept == {i for i, (_, root) in reference.near_copies(list(before.items()), 80).items() if i == root}
        elif name == "substring_dedup":
            expected = reference.without_repeats(list(before.items()))
            for r in rows:
                n, gone, digest = expected[r["doc_id"]]
                if gone:
                    assert reference.sha(r["text"]) == digest and r["n_chars"] == len(r["text"])
                else:
                    assert r["text"] == before[r["doc_id"]]
            assert kept == set(before)
        elif name == "decontaminate":
            hits = reference.benchmark_hits(list(before.items()), items)
            assert kept == {i for i, h in hits.items() if not h[4]}
        if name != "bpe":
            assert docs.columns == columns
            before = {r["doc_id"]: r["text"] for r in rows}
        else:
            assert kept == set(before) and all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_near_copies_where_ids_repeat(spark):
    import random

    random.seed(3)
    some = lambda: [random.choice("abcdefgh") + random.choice("klmnopqr") + str(random.randrange(40)) for _ in range(120)]
    base, other, third = some(), some(), some()
    near = [*base[:60], "changed", *base[61:]]
    rows = [(5, base), (7, near), (7, other), (7, other), (9, third), (None, third), (None, None), (8, [])]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t if t is None else " ".join(t), None, "s", 0) for i, t in rows], columns)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"] or 0, (r["text"] or "")[:12]) for r in kept.collect()))
    head = lambda t: " ".join(t)[:12]
    # A row without id comes first, so the third text stays there; the clean text under the repeated id stays once.
    assert found == sorted([(5, head(base)), (7, head(other)), (0, head(third)), (0, ""), (8, "")])
