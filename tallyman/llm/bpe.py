"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

A text is split at special tokens, normalised and cut into pieces; a piece is encoded by merging its symbols in the
order of the merge list. Pieces are mostly words. A piece of any length is encoded as a stream: a token is emitted as
soon as nothing that may follow can change it, so memory does not grow with the piece.

**Sufficient lookahead.** Take two texts that agree up to some place, and run the merges in order on both. Where they
stop agreeing moves left only when a rule ``(u, v)`` joins the last common token ``u`` with a token ``v`` behind
it, in one text alone; then it moves by ``len(u)``. A later rule ``(x, y)`` moves it again only if ``y`` stands
there, and ``y`` then begins with ``u``: ``u`` is ``y`` or the left part of a left part of ``y``. The longest
sum over such chains of rules of rising rank is computed in one pass over the merge list. Tokens that end at
least so far before the end of what has been read are final. This holds for lists in which each token is made by
one rule, behind the rules that make its parts; pieces are encoded whole for other lists.

Decoding joins the tokens' texts as the file's decoder says and turns bytes to text incrementally; a character that is
cut by the end of the input becomes U+FFFD.

Definitions: a null text is empty and has no tokens; special tokens in a text become their own ids, as the public
library does by default. Extra columns are ignored. Characters that Python's Unicode tables do not know yet may be
classed otherwise than in the public library.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tokens import release_memory

READ_SYMBOLS = 4096
CACHED_WORDS = 400_000
CACHED_WORD_LENGTH = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """A merge list over symbol ids."""

    def __init__(self, rules: list[tuple[int, int, int]], length: list[int]):
        self.rules = {(u, v): (rank, made) for rank, (u, v, made) in enumerate(rules)}
        self.lookahead = self._lookahead(rules, length)
        self.length = length

    @staticmethod
    def _lookahead(rules: list[tuple[int, int, int]], length: list[int]) -> int | None:
        left_part: dict[int, int] = {}
        results = {made for _, _, made in rules}
        if len(results) != len(rules):
            return None
        reach: dict[int, int] = {}
        longest = 0
        for u, v, made in rules:
            if (u in results and u not in left_part) or (v in results and v not in left_part):
                return None
            best, token = 0, v
            while token is not None:
                best = max(best, reach.get(token, 0))
                token = left_part.get(token)
            best += length[u]
            reach[u] = max(reach.get(u, 0), best)
            longest = max(longest, best)
            left_part[made] = u
        return longest

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the lowest rule first, the leftmost place first."""
        rules = self.rules
        if len(symbols) <= 24:
            symbols = list(symbols)
            while len(symbols) > 1:
                found = [rule for rule in map(rules.get, zip(symbols, symbols[1:], strict=False)) if rule is not None]
                if not found:
                    break
                rank, made = min(found)
                i, out, n = 0, [], len(symbols)
                while i < n:
                    if i + 1 < n and (rule := rules.get((symbols[i], symbols[i + 1]))) is not None and rule[0] == rank:
                        out.append(made)
                        i += 2
                    else:
                        out.append(symbols[i])
                        i += 1
                symbols = out
            return symbols
        symbols = list(symbols)
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            if (rule := rules.get((symbols[i], symbols[i + 1]))) is not None:
                heap.append((rule[0], i, symbols[i], symbols[i + 1], rule[1]))
        heapq.heapify(heap)
        while heap:
            _, i, u, v, made = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbols[i] != u or symbols[j] != v:
                continue
            symbols[i], alive[j] = made, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (rule := rules.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (rule[0], a, symbols[a], symbols[b], rule[1]))
        return [s for s, live in zip(symbols, alive, strict=True) if live]

    def stream(self, symbols: Iterable[int], read: int = READ_SYMBOLS) -> Iterator[int]:
        """Tokens of a stream of symbols, each as soon as it is final."""
        window: list[int] = []
        room = None if self.lookahead is None else self.lookahead + read
        for symbol in symbols:
            window.append(symbol)
            if room is not None and len(window) > room:
                stable, taken = len(window) - self.lookahead, 0
                for token in self.merge(window):
                    if taken + self.length[token] > stable:
                        break
                    taken += self.length[token]
                    yield token
                window = window[taken:]
        yield from self.merge(window)


class Codec:
    """Encoder and decoder for one vocabulary file: word-end BPE over bytes, as described in the file."""

    def __init__(self, description: str):
        spec = json.loads(description)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        supported = (
            model["type"] == "BPE"
            and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["behavior"] == "Removed"
            and splits[0]["invert"]
            and spec["decoder"] is None
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        )
        if not supported:
            raise ValueError("this vocabulary file has steps that are not supported")
        self.spaces = regex.compile(steps[1]["pattern"]["Regex"])
        self.space = steps[1]["content"]
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"])
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = specials
        longest_first = sorted(specials, key=lambda s: (-len(s), s))
        self.special_pattern = regex.compile("|".join(map(regex.escape, longest_first))) if specials else None
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = [vocabulary[c] for c in alphabet]
        self.final = [vocabulary[c + suffix] for c in alphabet]
        size = max([*vocabulary.values(), *specials.values()]) + 1
        self.texts = [b""] * size
        length = [0] * size
        for token, i in vocabulary.items():
            self.texts[i] = token.encode()
            length[i] = len(token.removesuffix(suffix)) if token != suffix else len(token)
        for token, i in specials.items():
            self.texts[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs], length)
        self.known: dict[str, bytes] = {}

    def normalised(self, text: str) -> str:
        text = self.spaces.sub(self.space, unicodedata.normalize("NFC", text))
        # Characters are lowered one by one: a final sigma is no special case.
        return text.replace("Σ", "σ").lower()

    def piece_symbols(self, piece: str) -> Iterator[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        for byte in raw[:-1]:
            yield self.inner[byte]
        yield self.final[raw[-1]]

    def piece_ids(self, piece: str) -> Iterator[int]:
        return self.merges.stream(self.piece_symbols(piece))

    def _packed(self, piece: str) -> bytes:
        found = np.fromiter(self.piece_ids(piece), np.dtype("<u4")).tobytes()
        if len(piece) <= CACHED_WORD_LENGTH:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        known = self.known
        for found in [*(self.special_pattern.finditer(text) if self.special_pattern else ()), None]:
            end = found.start() if found else len(text)
            for piece in self.pieces.findall(self.normalised(text[at:end])):
                ids = known.get(piece)
                out.append(self._packed(piece) if ids is None else ids)
            if found:
                out.append(np.array([self.specials[found[0]]], "<u4").tobytes())
                at = found.end()
        return b"".join(out)

    def decode(self, ids: Iterable[int], block: int = 1 << 16) -> Iterator[str]:
        """Text of the tokens, joined by blanks, in parts."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        texts, waiting, first = self.texts, [], True
        for i in ids:
            waiting.append(texts[i])
            if len(waiting) == block:
                yield machine.decode((b"" if first else b" ") + b" ".join(waiting))
                waiting, first = [], False
        if waiting:
            yield machine.decode((b"" if first else b" ") + b" ".join(waiting))
        if rest := machine.decode(b"", True):
            yield rest


_codecs: dict[str, Codec] = {}


def codec_of(description: str) -> Codec:
    """One codec for each file and worker process."""
    key = hashlib.sha256(description.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(description)
    return _codecs[key]


def _run(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            counts, id_digests, text_digests, packed = [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                raw = codec.encode(text or "")
                ids = np.frombuffer(raw, "<u4")
                digest = hashlib.sha256()
                for part in codec.decode(ids.tolist()):
                    digest.update(part.encode("utf-8", "surrogatepass"))
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(raw).hexdigest())
                text_digests.append(digest.hexdigest())
                if with_ids:
                    packed.append(ids.astype(np.int32))
            columns = {
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(id_digests, pa.string()),
                "decoded_sha256": pa.array(text_digests, pa.string()),
            }
            if with_ids:
                sizes = np.cumsum([0, *map(len, packed)]).astype(np.int32)
                flat = np.concatenate(packed) if packed else np.zeros(0, np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)
        codec.known.clear()
        release_memory()

    return run


def encode_documents(documents: DataFrame, vocabulary_file: str, with_ids: bool = True) -> DataFrame:
    """Token ids of every whole text, their count, and digests of the ids and of the text they decode to.

    The vocabulary file is read once on the driver; its size does not depend on the data.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return documents.select("doc_id", "text").mapInArrow(_run(shared, with_ids), schema)
