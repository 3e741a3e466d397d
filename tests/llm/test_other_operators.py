from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyman.llm import chat_format, embedding_dedup, license_scan

from . import reference


def brute(vectors, cosine=0.9):
    known = [(i, np.array(v, float)) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [
        (a, b)
        for n, (a, x) in enumerate(known)
        for b, y in known[n + 1 :]
        if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine
    ]
    counts = {i: 0 for i, _ in vectors}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    root = reference.roots(counts, links)
    return {i: (counts[i], root[i]) for i in counts}


@pytest.mark.parametrize("block", [512, 20])
def test_embedding_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    random = np.random.default_rng(4)
    base = random.normal(size=(300, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[7] + 0.05 * random.normal(size=24)).tolist()) for i in range(70)]
    rows += [(2000 + i, (3 * base[11]).tolist()) for i in range(5)] + [(2100, base[11].tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [None, 1.0]), (3004, [float("nan"), 1.0]), (3005, [1.0, 2.0])]
    data = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, bucket string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(data).collect()}
    expected = brute(rows)
    # Scaled copies lie on the same ray but for rounding, so every link is far from the threshold.
    assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in expected.items()}
    assert sum(v[0] for v in found.values()) >= 0.99 * sum(v[0] for v in expected.values())
    assert all(found[k][0] <= expected[k][0] for k in found)


def test_recall_at_the_threshold():
    random = np.random.default_rng(8)
    projections, tables = embedding_dedup.plan(50_000)
    hasher = embedding_dedup.Hasher(projections, tables, embedding_dedup.WIDTH)
    x = random.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = random.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert (hasher.keys(x) == hasher.keys(y)).any(axis=1).mean() > 0.92


def test_no_embeddings(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (None, None)], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["n_links"]) for r in embedding_dedup.near_duplicates(odd).collect()} == {(None, 0), (1, 0)}


MIT = dict(license_scan.KNOWN_TEXTS)["MIT"]


def test_license_forms(spark):
    rows = [
        (1, "MIT License\n"),
        (2, "Copyright (c) 2019 Some One\nAll rights reserved.\n\n" + MIT.upper().replace(",", " ,")),
        (3, MIT.replace("sublicense", "sub-licence")),
        (4, "Text before.\n  LICENSED under the Apache Licence - version 2.0\nReleased under the MIT License.\nReleased under the MIT License.\n"),
        (5, None),
        (6, ""),
        (7, "..."),
        (None, "Released under the MIT License."),
    ]
    data = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, digest string")
    got = {r["doc_id"]: (r["license"], r["n_notices"], r["notices"]) for r in license_scan.scan(data).collect()}
    assert got == {
        1: (None, 0, ""),
        2: ("MIT", 0, ""),
        3: ("MIT", 0, ""),
        4: (None, 3, "Apache-2.0 notice; MIT notice"),
        5: (None, 0, ""),
        6: (None, 0, ""),
        7: (None, 0, ""),
        None: ("MIT notice", 1, "MIT notice"),
    }
    digests = {r["doc_id"]: r["digest"] for r in license_scan.scan(data).collect()}
    assert digests[5] is None and digests[7] is None
    own = spark.createDataFrame([("b", "mit LICENCE"), ("a", "MIT license")], "license string, text string")
    assert license_scan.scan(data, own).filter("license = 'a'").count() == 1
    assert license_scan.scan(data.limit(0)).count() == 0


def test_documents_that_are_whole_licenses(spark):
    texts = dict(license_scan.FULL_TEXTS)
    bsd = "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + texts["BSD-3-Clause"]
    start, end = bsd.index("3. Neither"), bsd.index("THIS SOFTWARE IS")
    rows = list(texts.items())
    rows += [
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd),
        ("BSD-2-Clause", bsd[:start] + bsd[end:]),
        ("BSD-3-Clause", bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        ("Apache-2.0", texts["Apache-2.0"].split("   APPENDIX: How to apply")[0]),
        ("GPL-3.0", texts["GPL-3.0"].upper().replace("    ", "\t")),
        ("MIT", "MIT License\n\nCopyright (c) 2021 Some One\n\n" + MIT),
        (None, texts["MPL-2.0"] + "\nand more"),
        (None, texts["GPL-2.0"][:5000]),
    ]
    data = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(data).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}
    assert {"Apache-2.0", "BSL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"} <= set(texts)


def test_long_lists_of_licenses_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_TEXTS", 0)
    data = spark.createDataFrame([(1, MIT), (2, "x")], "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in license_scan.scan(data).collect()} == {(1, "MIT"), (2, None)}


TURNS = "pair_id long, chosen boolean, turn long, role string, text string, part string"


def samples(spark, rows):
    data = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    return sorted(tuple(r) for r in chat_format.preference_samples(data).collect())


def test_common_turns_are_rendered_once(spark):
    rows = []
    for chosen, last in ((True, "good"), (False, "bad")):
        rows += [(1, chosen, 0, "user", "hi <|x|>"), (1, chosen, 1, "assistant", "yes"), (1, chosen, 2, "assistant", last)]
    rows += [(1, False, 3, "user", "more"), (1, False, 3, "user", "more"), (2, True, 0, "user", "alone")]
    assert samples(spark, rows) == [
        (1, "chosen", 2, "assistant", "<|assistant|>\ngood<|end|>\n", 1),
        (1, "prompt", 0, "user", "<|user|>\nhi < |x|><|end|>\n", 0),
        (1, "prompt", 1, "assistant", "<|assistant|>\nyes<|end|>\n", 0),
        (1, "rejected", 2, "assistant", "<|assistant|>\nbad<|end|>\n", 1),
        (1, "rejected", 3, "user", "<|user|>\nmore<|end|>\n", 0),
    ]


def test_odd_turns(spark):
    same = [(4, chosen, turn, None, None) for chosen in (True, False) for turn in (None, 1)]
    assert [r[1:] for r in samples(spark, same)] == [
        ("prompt", chat_format.FIRST_TURN, "unknown", "<|unknown|>\n<|end|>\n", 0),
        ("prompt", 1, "unknown", "<|unknown|>\n<|end|>\n", 0),
    ]
    tied = [(5, True, 0, "user", "a"), (5, True, 0, "user", "b"), (5, False, 0, "user", "b"), (5, False, 0, "user", "a"), (5, True, 1, "user", "c")]
    assert [r[1] for r in samples(spark, tied)] == ["chosen", "prompt", "prompt"]
    assert samples(spark, [(None, True, 0, "user", "a"), (6, None, 0, "user", "a")]) == []


def test_pairs_of_neighbours(spark):
    data = spark.createDataFrame([(0, 0, "user", "q"), (1, 0, "user", "q"), (None, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    pairs = chat_format.neighbours(data)
    assert sorted((r["pair_id"], r["chosen"]) for r in pairs.collect()) == [(0, False), (0, True)]
    assert pairs.agg(F.count("*")).first()[0] == 2
