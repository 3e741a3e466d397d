"""Plain Python counterparts of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(documents: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    seen: set[tuple[str, ...]] = set()
    result = {}
    for doc_id, text in sorted(documents, key=lambda d: d[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        result[doc_id] = (len(words), sum(gone), sha(kept))
    return result


def roots(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_copies(documents: list[tuple[int, str | None]], percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in documents}
    owners = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    common: Counter = Counter()
    for ids in owners.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return {i: (len(sets[i]), root) for i, root in roots(sets, links).items()}


def benchmark_hits(documents, items, window: int = 10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    owners = defaultdict(set)
    for item, text in items:
        words = split.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            owners[tuple(words[i : i + size])].add(str(item))
    sizes = {len(k) for k in owners}
    result = {}
    for doc_id, text in documents:
        words = split.findall(lower(text))
        hit, found = [False] * len(words), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if names := owners.get(tuple(words[i : i + size])):
                    found |= names
                    hit[i : i + size] = [True] * size
        result[doc_id] = (len(words), sum(hit), len(found), sha(",".join(sorted(found))), any(hit))
    return result


def backoff_scores(documents: dict[int, str | None], training: set[int], strength: float):
    texts = {i: ["<s>", *WORD.findall(lower(t)), "</s>"] for i, t in documents.items()}
    single, double = Counter(), Counter()
    for i in training:
        single.update(texts[i])
        double.update(zip(texts[i], texts[i][1:], strict=False))
    total = sum(n for w, n in single.items() if w != "<s>")
    types = sum(1 for w in single if w != "<s>")
    result = {}
    for i, words in texts.items():
        p = {w: (single[w] + 1) / (total + types + 1) for w in words}
        base = sum(math.log10(p[w]) for w in words[1:])
        whole = sum(
            math.log10((double[v, w] + strength * p[w]) / (single[v] + strength)) for v, w in zip(words, words[1:], strict=False)
        )
        result[i] = (len(words) - 1, sum(single[w] > 0 for w in words[1:]), total, base, whole)
    return result
