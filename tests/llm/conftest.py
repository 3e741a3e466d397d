from __future__ import annotations

import random

import pytest

from tallyman.llm.shared import prepared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket string, key string, a int, b int"


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int, str | None]]:
    """Random texts with exact copies, near copies, shared passages, runs of one word and odd cases."""
    random.seed(11)
    words = [random.choice("bcdfgklmnprst") + random.choice("aeiou") + random.choice(["", "n", "r", "sta", "Lo"]) for _ in range(300)]
    some = lambda n: [random.choice(words) for _ in range(n)]
    passage, base = some(60), some(150)
    texts: list[str | None] = [" ".join(base), " ".join(base), "  ".join(base) + "\n"]
    for _ in range(6):
        near = list(base)
        near[random.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    for _ in range(8):
        texts.append(" ".join(some(30) + passage[random.randrange(10) :] + some(25)))
    texts += ["la " * 50, "x y z " * 20, "", None, " \t\n ", "one", "a b c d", "a b c d", "A B C D", "é ü ß 語 " * 12]
    texts += [" ".join(some(40)) for _ in range(6)]
    texts.append(" ".join(some(9000)))
    order = list(range(len(texts)))
    random.shuffle(order)
    return list(zip(order, texts, strict=True))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names the operators use inside."""
    rows = [(i, t, "en" if i % 2 else "de", "s", 0, "c", "b", "k", 1, 2) for i, t in corpus]
    return prepared(spark).createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null ids and repeated rows."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, None), (5, text), (5, text), (6, text), (7, None), (7, "other words"), (-3, "")]
    return spark.createDataFrame([(i, t, None, None, None, "c", "b", "k", 1, 2) for i, t in rows], SCHEMA)
