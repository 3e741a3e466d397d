from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyman.llm import bpe, decontaminate, language_id, lm_score, minhash_dedup, substring_dedup, toxicity
from tallyman.llm.packing import pack, unpack
from tallyman.llm.shared import components, held_out
from tallyman.llm.tokens import PLAIN_WORDS, split_words

from . import reference

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_those_of_plain_python(corpus):
    raw = [(t or "").encode() for _, t in corpus]
    words = split_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), PLAIN_WORDS)
    buffer = words.buffer.tobytes()
    found = [buffer[a:b] for a, b in zip(words.starts, words.ends, strict=True)]
    for k, text in enumerate(raw):
        assert found[words.bounds[k] : words.bounds[k + 1]] == text.split()
    by_hash = dict(zip(words.hashes().tolist(), found, strict=True))
    assert len(by_hash) == len(set(found))


def test_packing_round_trip():
    parts = [np.arange(1000, dtype=np.uint64) ** 3, b"some\ntext", np.zeros(0, np.int32), b""]
    for a, b in zip(unpack(pack(*parts)), parts, strict=True):
        assert a == b if isinstance(b, bytes) else (a.dtype == b.dtype and (a == b).all())


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 301), (301, 300)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    expected = reference.roots({n for pair in links for n in pair}, links)
    assert dict(map(tuple, found.collect())) == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup_equals_plain_python(documents, corpus):
    rows = {r["doc_id"]: r for r in substring_dedup.dedup(documents, carry=("chunk", "a")).collect()}
    expected = reference.without_repeats(corpus)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in rows.items()} == expected
    assert sum(n for _, n, _ in expected.values()) > 500
    assert all(r["chunk"] == "c" and r["a"] == 1 for r in rows.values())
    texts = dict(corpus)
    assert all(r["kept_text"] == texts[i] for i, r in rows.items() if not r["n_removed"])


def test_substring_dedup_with_hot_minimisers(documents, corpus, monkeypatch):
    answer = substring_dedup._answer
    monkeypatch.setattr(substring_dedup, "HOT_STRINGS", 1)
    assert answer.__globals__["HOT_STRINGS"] == 1
    first = np.array([0, 30]), np.array([60, 90]), np.array([7, 9], np.uint64)
    data = b" ".join(b"w%d" % i for i in range(100))
    words = split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    start, end, key = substring_dedup._alone(*first, words, 20, np.array([9], np.uint64))
    assert start.tolist() == [0, *range(30, 71)] and (end[1:] - start[1:] == 20).all() and len(set(key.tolist())) == 42


def _hot_corpus() -> list[tuple[int, str]]:
    random.seed(31)
    fresh = (f"f{i}" for i in range(10**6))
    passage = [f"p{i}" for i in range(45)]
    some = lambda n: [next(fresh) for _ in range(n)]
    rows = [(i, " ".join(some(25) + passage[random.randrange(3) :] + some(25))) for i in range(60)]
    rows += [(100 + i, " ".join(passage[:25] + some(3) + passage[:25] + ["p0"] * (i % 3))) for i in range(6)]
    return rows + [rows[3], (3, rows[7][1])] + [(200, "la " * 60)]


def test_hot_windows_are_decided_in_the_chunk(spark, monkeypatch):
    real, sent = substring_dedup._answer, []

    def all_hot(table):
        parts = [unpack(x) for x in table.column("packed").to_pylist()]
        return table.set_column(2, "packed", pa.array([pack(np.full(len(c), 2, np.uint8)) for _, c in parts], pa.binary()))

    rows = _hot_corpus()
    text_keys = {t: k for k, t in enumerate(sorted({t for _, t in rows}))}
    table = pa.table(
        {
            "chunk": pa.array([0] * len(rows), pa.int64()),
            "doc": pa.array([i for i, _ in rows], pa.int64()),
            "text_key": pa.array([text_keys[t] for _, t in rows], pa.int64()),
            "text": [t for _, t in rows],
        }
    )
    asked = substring_dedup._ask(20, 4, 8)(table)
    message = substring_dedup._send(20, 4, 8)(table, all_hot(asked))
    for bucket, packed in zip(message.column("bucket").to_pylist(), message.column("packed").to_pylist(), strict=True):
        if bucket >= 0:
            sent += unpack(packed)[3].split(b"\n")
    assert len(sent) == len(set(sent)) > 1000 and {len(s.split()) for s in sent} == {20}
    # Through the whole query, with every shared minimiser hot.
    monkeypatch.setattr(substring_dedup, "_answer", all_hot)
    unique = [r for n, r in enumerate(rows) if n not in (66, 67)]
    for chunk_bytes in (1 << 22, 2000):
        monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk_bytes)
        found = substring_dedup.dedup(spark.createDataFrame(unique, "doc_id long, text string")).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found}
        assert got == reference.without_repeats(unique)
    twice = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    monkeypatch.setattr(substring_dedup, "_answer", real)
    cold = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, cold))


def test_substring_dedup_odd_rows(odd_documents, no_documents):
    rows = substring_dedup.dedup(odd_documents).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["n_words"], r["n_removed"]) for r in rows)
    # The null id comes first and keeps its words; both rows of document 5 are one document.
    assert got == [(-99, 0, 0), (-99, 30, 0), (-3, 0, 0), (5, 30, 30), (5, 30, 30), (6, 30, 30), (7, 0, 0), (7, 2, 0)]
    assert substring_dedup.dedup(no_documents).count() == 0


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "range_hashes", lambda codes, starts, ends, base=1: np.zeros(len(starts), np.uint64))
    strings = [" ".join(f"{k}{i}" for i in range(20)) for k in "aba"]
    owner, doc, _, start, end = substring_dedup.repeated_windows(
        np.array([1, 2, 3]), np.zeros(3, np.int64), np.zeros(3, np.int32), "\n".join(strings).encode(), 20
    )
    assert doc.tolist() == [3] and owner.tolist() == [2] and start.tolist() == [0] and end.tolist() == [20]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies_equal_plain_python(documents, corpus, percent):
    rows = minhash_dedup.near_duplicates(documents, percent).collect()
    expected = reference.near_copies(corpus, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert len({c for _, c in expected.values()}) < len(expected) - 8


def test_near_copies_odd_rows(odd_documents, no_documents):
    rows = minhash_dedup.near_duplicates(odd_documents).collect()
    assert len(rows) == 8
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(None, None), (5, 5), (6, 5), (7, 7), (-3, -3)}
    assert minhash_dedup.near_duplicates(no_documents).count() == 0


def test_circulant_signature_estimates_similarity():
    random.seed(3)
    values = np.array([random.getrandbits(64) for _ in range(3000)], np.uint64)
    a, b = values[:2000], values[1000:]
    same = np.mean(minhash_dedup.circulant_signature(a, 1024) == minhash_dedup.circulant_signature(b, 1024))
    assert abs(same - 1 / 3) < 0.06


TEXTS = [
    "",
    "Hello, World's best don't I'LL 42!!!",
    "<|endoftext|>a<|startoftext|> <|endoftext|",
    "ΟΔΟΣ İstanbul ﬁn é é ß   x",
    "日本語テキスト 🙂🙃 नमस्ते",
    "a" * 5000,
    "".join(random.Random(5).choice("aeinrsthlo") for _ in range(9000)),
]


@pytest.fixture(scope="module")
def codec():
    with open(FILE, encoding="utf-8") as file:
        return bpe.Codec(file.read())


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_equals_the_public_library(codec, text):
    public = Tokenizer.from_file(FILE)
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert "".join(codec.decode(ids, block=3)) == public.decode(ids, skip_special_tokens=False)


def test_bpe_stream_with_little_room_equals_whole_merge(codec):
    lookahead = codec.merges.lookahead
    assert 0 < lookahead < 2000
    symbols = list(codec.piece_symbols("".join(random.Random(9).choice("thein") for _ in range(6000))))
    assert list(codec.merges.stream(symbols, read=1)) == codec.merges.merge(symbols)


def test_bpe_lists_out_of_order_have_no_lookahead():
    assert bpe.Merges([(4, 2, 5), (0, 1, 4)], [1, 1, 1, 1, 2, 3]).lookahead is None
    assert bpe.Merges([(0, 1, 4), (4, 2, 5)], [1, 1, 1, 1, 2, 3]).lookahead == 2


def test_bpe_documents(documents, odd_documents, no_documents, corpus):
    public = Tokenizer.from_file(FILE)
    texts = dict(corpus)
    for row in bpe.encode_documents(documents, FILE).collect():
        ids = public.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == reference.sha(public.decode(ids, skip_special_tokens=False))
    assert bpe.encode_documents(odd_documents, FILE).count() == 8
    assert bpe.encode_documents(no_documents, FILE).count() == 0


def test_language_id_on_held_out_rows(spark, sf_dir, odd_documents, no_documents):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    model = language_id.fit(table.filter(~out))
    found = language_id.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").filter(out)
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.95
    names, score, rejected = model.predict([None, "", "123 ... 45 ²", "the and of the was in", "the and" * 400_000])
    assert names[:3] == ["und"] * 3 and rejected[:3].all() and (score[:3] == 0).all()
    assert names[3:] == ["en", "en"] and not rejected[3:].any()
    assert language_id.predict(odd_documents, model).count() == 8
    assert language_id.predict(no_documents, model).count() == 0
    kept = language_id.accepted(odd_documents, model)
    assert kept.columns == odd_documents.columns and kept.filter("text IS NULL OR text = ''").count() == 0
    nothing = language_id.predict(odd_documents, language_id.fit(no_documents)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


@pytest.mark.parametrize("unlearned", ["de", "fr"])
def test_texts_of_an_unlearned_language_are_rejected(spark, unlearned):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"], r["lang"]) for r in table.filter("length(text) > 200").collect())
    learnt = [r for r in rows if r[0] % 3 and r[2] != unlearned]
    model = language_id.train([t for _, t, _ in learnt], [k for _, _, k in learnt], epochs=2)
    known = [t for i, t, k in rows if i % 3 == 0 and k != unlearned]
    unknown = [t for _, t, k in rows if k == unlearned]
    shuffler = np.random.default_rng(3)
    noise = [language_id._shuffled(language_id.letters(t), shuffler).decode() for t in known]
    share = lambda texts: model.predict(texts)[2].mean()
    assert share(unknown) > 0.95 and share(noise) > 0.95
    assert share(known) == 0 and share([t[:40] for t in known]) < 0.01
    others = ["Привет, как дела сегодня? " * 5, "今日は天気がいいですね。" * 9, "zxq vbk qqj xzz wvx kjq " * 9]
    assert model.predict(others)[2].all()


def test_language_scores_do_not_depend_on_neighbours(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).collect()]
    model = language_id.train(texts, ["de", "en"] * 10, epochs=1)
    together = model.predict(texts)[1]
    alone = np.array([model.predict([t])[1][0] for t in texts])
    assert np.allclose(together, alone, atol=1e-9)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_equals_plain_python(spark, documents, corpus, block_bytes):
    texts = dict(corpus)
    long = max(corpus, key=lambda d: len(d[1] or ""))[0]
    words = texts[long].split()
    items = [(1, " ".join(words[100:140]).upper()), (2, " ".join(words[120:128])), (2, " ".join(words[120:128])), (3, None), (4, "..")]
    items += [(10, "one"), (None, "a, b; c - d"), (12, "never found in any text of the corpus at all, really")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(documents, benchmark, block_bytes=block_bytes).collect()
    expected = reference.benchmark_hits(corpus, [("null" if i is None else i, t) for i, t in items])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
    assert got == expected and sum(e[4] for e in expected.values()) >= 5
    spans = {r["doc_id"]: r["spans"] for r in rows}
    cut = [texts[long][s["from"] : s["to"]] for s in spans[long]]
    assert cut == [" ".join(words[100:140])]
    assert all(s["to"] - s["from"] >= 1 for found in spans.values() for s in found)
    assert {i for i, found in spans.items() if found} == {i for i, e in expected.items() if e[4]}
    clean = {r["doc_id"] for r in decontaminate.clean(documents, benchmark, block_bytes=block_bytes).collect()}
    assert clean == {i for i, e in expected.items() if not e[4]}


def test_blocks_of_a_large_benchmark_are_bounded(spark):
    random.seed(5)
    vocabulary = [f"w{n:05d}" for n in range(20000)]
    items = [(i, " ".join(random.choices(vocabulary, k=200))) for i in range(300)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    blocks, parts = decontaminate._blocks(benchmark, 10, 1 << 20)
    sizes = []
    for shared in parts:
        sizes.append(sum(len(key) for key, _, _ in shared.value))
        shared.destroy()
    assert blocks == len(sizes) >= 4 and max(sizes) < 1.2 * (1 << 20) and sum(sizes) == 300 * 191 * 69
    text = "X " + items[7][1][:350].upper() + ". " + items[250][1][70:300]
    documents = spark.createDataFrame([(1, text), (2, items[7][1][:60]), (2, None)], "doc_id long, text string")
    found = decontaminate.contamination(documents, benchmark, block_bytes=1 << 20).orderBy("doc_id", "n_words").collect()
    assert [(r["doc_id"], r["n_words"], r["items"]) for r in found] == [(1, 84, ["250", "7"]), (2, 0, []), (2, 9, [])]
    assert [tuple(s) for s in found[0]["spans"]] == [(2, len(text))] and found[0]["n_hit"] == 83


def test_decontamination_of_nothing(spark, odd_documents, no_documents):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd_documents, benchmark).filter("contaminated").count() == 0
    assert decontaminate.contamination(no_documents, benchmark).count() == 0
    assert decontaminate.clean(odd_documents, benchmark).count() == 8


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 3000])
def test_scores_equal_plain_python(documents, corpus, chunk_bytes):
    training = {i for i, _ in corpus if i % 3}
    rows = lm_score.score(documents, F.col("doc_id") % 3 != 0, strength=5.0, chunk_bytes=chunk_bytes).collect()
    expected = reference.backoff_scores(dict(corpus), training, 5.0)
    assert len(rows) == len(corpus)
    for r in rows:
        n, known, total, base, whole = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, r["doc_id"] % 3 == 0)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(whole, rel=1e-9)


def test_scores_of_odd_rows_and_longer_contexts(odd_documents, no_documents):
    rows = lm_score.score(odd_documents, F.lit(True), order=3).collect()
    assert len(rows) == 8 and all(r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] == -3} == {1}
    assert lm_score.score(no_documents, F.lit(True)).count() == 0
    untrained = lm_score.score(odd_documents, F.lit(None).cast("boolean")).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == 0 for r in untrained)


def test_toxicity_on_held_out_rows(spark, no_documents, odd_documents):
    folder = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    out = held_out(F.col("doc_id"), 4, 2)
    scorer = toxicity.fit(table, labels.filter(~out))
    rows = toxicity.score(table.join(labels.select("doc_id"), "doc_id", "left_semi").filter(out), scorer)
    found = rows.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").toPandas()
    rank, n = found["score"].rank(), int((found["toxic"] == 1).sum())
    area = (rank[found["toxic"] == 1].sum() - n * (n + 1) / 2) / (n * (len(found) - n))
    assert area > 0.9
    assert toxicity.score(odd_documents, scorer).filter("score BETWEEN 0 AND 1").count() == 8
    assert toxicity.score(no_documents, scorer).count() == 0
    unlabelled = toxicity.fit(table, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd_documents, unlabelled).collect()} == {0.0}


def test_toxic_expression_deep_in_a_word_without_blanks():
    random.seed(21)
    calm, rude = "山川草木花鳥風月春夏秋冬", "愚鈍卑劣醜悪"
    some = lambda: "".join(random.choice(calm) for _ in range(60))
    ordinary = [some() for _ in range(40)]
    toxic = [t[:k] + rude + t[k:] for k, t in enumerate(some() for _ in range(40))]
    scorer = toxicity.train(ordinary, toxic, 0.5)

    def score(*texts):
        return scorer.scores(scorer.features(toxicity._words_of(list(texts)), toxicity.Memory()))

    plain = some() * 20
    places = [30, 31, 150, 400, 1190]
    clean, *found = score(plain, *(plain[:k] + rude + plain[k:] for k in places), "x" * 70 + rude, rude)
    assert clean < 0.5 and min(found) > 0.5


def plain_differences(ordinary, toxic, words):
    """Class-conditional Kneser-Ney with dictionaries: order 6, orders 1 and 2 from the larger count of both classes."""
    sequence = lambda w: [32] * 5 + list(w.encode()) + [32]
    counts = [{} for _ in range(7)]
    for mark, texts in enumerate((ordinary, toxic)):
        for word in " ".join(texts).split():
            s = sequence(word)
            for i in range(5, len(s)):
                counts[6].setdefault(tuple(s[i - 5 : i + 1]), [0, 0])[mark] += 1
    for k in range(6, 0, -1):
        if k <= 2:
            counts[k] = {g: [max(n)] * 2 for g, n in counts[k].items()}
        if k > 1:
            for gram, n in counts[k].items():
                shorter = counts[k - 1].setdefault(gram[1:], [0, 0])
                for c in (0, 1):
                    shorter[c] += n[c] > 0
    off = [[0, 0] for _ in range(7)]
    total = [{} for _ in range(7)]
    for k in range(1, 7):
        for c in (0, 1):
            once, twice = (sum(n[c] == times for n in counts[k].values()) for times in (1, 2))
            off[k][c] = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
        for gram, n in counts[k].items():
            row = total[k].setdefault(gram[:-1], [0, 0, 0, 0])
            for c in (0, 1):
                row[c] += n[c]
                row[2 + c] += n[c] > 0

    def log_likelihood(word, c):
        s, found = sequence(word), 0.0
        for i in range(5, len(s)):
            p = 1 / 257
            for k in range(1, 7):
                gram = tuple(s[i - k + 1 : i + 1])
                sums = total[k].get(gram[:-1], [0] * 4)
                if sums[c]:
                    p = max(counts[k].get(gram, [0, 0])[c] - off[k][c], 0) / sums[c] + off[k][c] * sums[2 + c] / sums[c] * p
            found += np.log(p)
        return found

    return [log_likelihood(w, 1) - log_likelihood(w, 0) for w in words]


def test_toxicity_models_equal_plain_python():
    random.seed(8)
    some = lambda letters, n: " ".join("".join(random.choices(letters, k=random.randrange(1, 9))) for _ in range(n))
    ordinary, toxic = [some("abcde", 30) for _ in range(10)], [some("cdefg", 30) for _ in range(10)]
    words = [*some("abcdefgh", 40).split(), "abc" * 30, "g" * 64, "é語", ordinary[0].split()[0]]
    tested = toxicity._words_of([" ".join(words)])
    parts = toxicity.Parts(tested)
    cells = toxicity._spelling_of(ordinary, toxic).differences(parts, np.arange(len(parts.last)))
    found = np.add.reduceat(cells, parts.first)
    assert np.allclose(found, plain_differences(ordinary, toxic, words), rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize(("calm", "rude", "constant"), [(0, 0, 0.0), (5, 0, 0.0), (0, 5, 1.0), (5, 2, 2 / 7), (2, 5, 5 / 7)])
def test_too_few_labels_give_their_share(calm, rude, constant):
    scorer = toxicity.train(["a b c"] * calm, ["d e f"] * rude, rude / max(1, calm + rude))
    texts = toxicity._words_of(["a word", "", "x" * 100, "d"])
    assert scorer.scores(scorer.features(texts, toxicity.Memory())).tolist() == [constant] * 4


def test_values_of_long_words():
    words = toxicity._words_of(["a " + "b" * 32 + " " + "c" * 33 + " " + "d" * 97 + " " + "e" * 160])
    parts = toxicity.Parts(words)
    assert parts.counts.tolist() == [1, 1, 2, 4, 5] and parts.words.bounds.tolist() == [0, 13]
    assert (parts.words.ends - parts.words.starts - parts.lead).tolist() == [1, 32, 32, 1, 32, 32, 32, 1, *[32] * 5]
    values = np.array([2.0, -3, 1, -5, 1, 2, 3, -9, -1, 5, -1, 5, -1])
    assert parts.word_values(values).tolist() == [2, -3, -4, 6, 9]


def test_a_letter_more_changes_little():
    random.seed(4)
    calm = [" ".join("".join(random.choices("abcde", k=12)) for _ in range(20)) for _ in range(60)]
    rude = [t + " ebdaceb" for t in calm]
    scorer = toxicity.train(calm, rude, 0.5)
    line = "".join(random.choices("abcde", k=300))
    sizes = [31, 32, 33, 63, 64, 65, 96, 97, 128, 129]
    texts = [line[: n // 2] + "ebdaceb" + line[n // 2 : n - 7] for n in sizes]
    features = scorer.features(toxicity._words_of(texts), toxicity.Memory())
    for low, high in ((0, 2), (3, 5), (6, 7), (8, 9)):
        assert np.abs(np.diff(features[low : high + 1, :2], axis=0)).max() < 0.5


def test_repeated_ids_and_long_texts_in_training(spark):
    rows = [(i % 40, f"word{i % 7} text {i}", "en") for i in range(400)] + [(99, "long " * 40000, "en"), (None, "none", "de")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "doc_id long, toxic int")
    one, other = (toxicity.fit(documents.repartition(n), labels) for n in (2, 5))
    assert np.array_equal(one.weights, other.weights)
    assert language_id.fit(documents).languages == ["en"]


def test_languages_equal_plain_averages(corpus):
    texts = [t for _, t in corpus if t] * 3
    model = language_id.train(texts, [("x", "y", "z")[len(t) % 3] for t in texts])
    names, score, _ = model.predict([t for _, t in corpus])
    for (_, text), name, value in zip(corpus, names, score, strict=True):
        form = language_id.letters(text)
        if not form:
            assert (name, value) == ("und", 0)
            continue
        logits = np.zeros(3)
        runs = [r for part in language_id._runs_of(form) for r in part.tolist()]
        spans = [(i, k) for k in language_id.RUNS for i in range(len(form) - k + 1) if b" " not in form[i : i + k][1:-1]]
        spans = [(i, k) for i, k in spans if form[i : i + k] not in (b" ", b"  ")]
        assert len(runs) == len(spans)
        for run in runs:
            logits += model.table[run % len(model.table)]
        shares = np.exp((logits / len(runs) + model.bias) / model.temperature)
        shares /= shares.sum()
        assert (name, value) == (model.languages[int(shares.argmax())], pytest.approx(shares.max(), rel=1e-5))
