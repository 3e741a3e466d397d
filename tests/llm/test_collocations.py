from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from tallyman.llm import collocations as op


def brute(rows, max_words=3, min_count=10, top=2000, inside=50):
    """Plain counting of every run of words."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for size in range(1, max_words + 1):
                f.update((lang or "und", *words[i : i + size]) for i in range(len(words) - size + 1))
    candidates = {g: c for g, c in f.items() if len(g) > 2 and c >= min_count}
    by_lang = collections.defaultdict(list)
    for g, a in candidates.items():
        lang, *w = g
        inside_of = [
            c for h, c in candidates.items()
            if h[0] == lang and len(h) > len(g) and any(h[i : i + len(w)] == tuple(w) for i in range(1, len(h)))
        ]
        if any(100 * c >= inside * a for c in inside_of):
            continue
        cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min((1000000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        by_lang[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in by_lang.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


def rows_of(spark, rows, parts=3):
    schema = "text string, lang string, doc_id long, chunk string, codes int, n long, words string"
    return spark.createDataFrame([(t, g, 1, "c", 1, 2, "w") for t, g in rows], schema).repartition(parts)


def found(frame):
    return {tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    words = ["a", "B", "c", "New", "york", "city", "é", "語", "d\x00", "x-y"]
    rows = []
    for i in range(160):
        picked = random.choices(words, k=random.randrange(30))
        if i % 2:
            picked += ["new", "York", "City"] * random.randrange(3)
        rows.append((random.choice([" ", "  ", "\t", " . "]).join(picked) + random.choice(["", ".", "\n", ";b a"]), random.choice(["en", "de", None, "und"])))
    return [*rows, *rows[:9], (None, "en"), ("", None), (" .,\n", "fr"), ("word " * 500, "fr"), ("a a a a", "en")]


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 100}, {"top": 5}, {"max_words": 5, "min_count": 4}, {"max_words": 2}])
def test_equals_plain_counting(spark, texts, settings):
    frame = op.collocations(rows_of(spark, texts), **settings)
    wanted = {"max_words", "min_count", "top"}
    assert found(frame) == brute(texts, **{k: v for k, v in settings.items() if k in wanted})


def test_nothing_to_find(spark):
    assert not found(op.collocations(rows_of(spark, [])))
    assert not found(op.collocations(rows_of(spark, [(None, None), ("", "en"), ("one two", "en")])))


def test_the_earliest_of_equal_cuts_and_large_numbers(spark):
    # f(a b) f(c) equals f(a) f(b c): the first cut's parts are reported.
    rows = [("a b c", "en")] * 12
    assert found(op.collocations(rows_of(spark, rows))) == {("en", 1, "a b c", 12, 12, 12, 36, 1000000)}


def test_pieces_are_never_cut():
    data = np.frombuffer(b"one two three. four five six seven, eight", np.uint8)
    parts = [p.tobytes() for p in op.stretches(data, 10)]
    assert b"".join(parts) == data.tobytes()
    assert parts == [b"one two three.", b" four five six seven,", b" eight"]


def test_what_a_chunk_lists_is_stored_in_rows_of_bounded_size(spark, monkeypatch):
    random.seed(5)
    words = [f"w{i}" for i in range(200)]
    lists = [[*random.choices(words, k=3500), *(f"rare{i}-{j}" for j in range(900))] for i in range(40)]
    rows = [(" ".join(x), "en") for x in lists]
    stored, cut = {}, op.cut_lineage

    def measured(frame, *args, **options):
        table = cut(frame, *args, **options)
        for name, kind in table.dtypes:
            if kind.startswith("array"):
                n, most, total = table.selectExpr(f"count({name})", f"max(size({name}))", f"sum(size({name}))").first()
                stored.setdefault(name, []).append((n, most, total))
            if name == "codes":
                assert table.selectExpr("max(octet_length(codes))").first()[0] <= 4 * op.ROW_POSITIONS
                stored.setdefault(name, []).append(table.selectExpr("count(codes)").first()[0])
        return table

    monkeypatch.setattr(op, "cut_lineage", measured)
    assert found(op.collocations(rows_of(spark, rows, 1))) == brute(rows)
    assert [most <= op.ROW_ITEMS < total for _, most, total in (stored["words"][0], stored["pairs"][0])] == [True, True]
    assert stored["codes"][:2] == [2, 2]
