from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyman.llm import conversation_repair as op

SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, (turn is not None, turn), "user" if kind == 4 else role, text


def solve(rows):
    """Cheapest edits of ``(role, text, fault)`` rows by trying all, least audit first among equals."""
    follow = {0: "u", 1: "u", 2: "a", 3: "u"}
    state_of = {"u": 2, "a": 3}
    roles = {"u": "user", "a": "assistant"}
    ways = {0: (0, "", ()), 2: (3, "I", ("user:",)), 3: (6, "II", ("user:", "assistant:"))}
    for role, text, fault in rows:
        found: dict[int, list] = {}
        for s, (cost, audit, lines) in ways.items():
            found.setdefault(s, []).append((cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            initial = role[:1]
            if initial == follow[s]:
                found.setdefault(state_of[initial], []).append((cost, audit + "K", (*lines, f"{role}:{text}")))
            if s == 0 and initial == "s":
                found.setdefault(1, []).append((cost, audit + "K", (*lines, f"{role}:{text}")))
            new = follow[s]
            found.setdefault(state_of[new], []).append((cost + 3, audit + "R", (*lines, f"{roles[new]}:{text}")))
        for _ in range(2):
            for s, options in list(found.items()):
                cost, audit, lines = min(options)
                new = follow[s]
                found.setdefault(state_of[new], []).append((cost + 3, audit + "I", (*lines, roles[new] + ":")))
        ways = {s: min(options) for s, options in found.items()}
    return min(ways[s] for s in (0, 3) if s in ways)


def brute(rows):
    found = {}
    after = list(damage(rows))
    for conv in {r[0] for r in rows}:
        mine = sorted((t, role, hashlib.sha256(text.encode()).digest(), text) for c, t, role, text in after if c == conv)
        seen, judged = set(), []
        for _, role, _, text in mine:
            left = text.rstrip(SPACES)
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for (known, t), *_ in mine if known]
        initials = [role[:1] for role, *_ in judged]
        cost, audit, lines = solve(judged) if judged else (0, "", ())
        count = [sum(f == k for *_, f in judged) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def run(spark, rows, **settings):
    schema = "conv_id long, turn int, role string, text string, block int, kind string, copies int, place int"
    frame = spark.createDataFrame([(*r, 1, "k", 5, 2) for r in rows], schema).repartition(3)
    results = op.repair(op.damaged(frame), **settings).collect()
    assert len(results) == len({r["conv_id"] for r in results})
    return {r["conv_id"]: tuple(r)[1:] for r in results}


@pytest.fixture(scope="module")
def conversations():
    random.seed(12)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool"]
    texts = ["Yes.", "No!", "why?", "cut", "", " \n", None, "é. \t", "ends.\x0b", "a:b\nc."]
    rows = []
    for conv in range(300):
        usual = conv % 2
        for turn in range(random.randrange(1, 12)):
            role = ("user", "assistant")[turn % 2] if usual and random.random() < 0.8 else random.choice(roles)
            rows.append((conv, None if random.random() < 0.05 else turn + turn // 7, role, random.choice(texts)))
    rows += rows[5:25]
    rows += [(None, i, "user", f"t{i}.") for i in range(5)] + [(None, None, None, None), (-4, None, "assistant", "x.")]
    return rows


@pytest.mark.parametrize("stretch", [op.STRETCH, 3])
def test_equals_trying_all_edits(spark, conversations, stretch):
    assert run(spark, conversations, stretch=stretch) == brute(conversations)


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(op, "ROWS_AT_ONCE", 50)
    random.seed(5)
    rows = [(1, i, random.choice(["user", "assistant", "system"]), f"{random.randrange(900)}" + random.choice([".", ""])) for i in range(6000)]
    rows += [(2, 7, "user", "same.")] * 3000 + [(2, i, "assistant", "again.") for i in range(3000)]
    rows += [(i, 0, "user", "short.") for i in range(3, 200)]
    assert run(spark, rows, stretch=512) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_costs_and_paths_of_any_codes():
    random.seed(2)
    names, faults = ["s", "u", "a", "x"], ["", "truncated", "blank", "duplicate"]
    codes = [np.array([random.randrange(16) for _ in range(random.randrange(40))], np.uint8) for _ in range(400)]
    for found, code in zip(op.repaired(codes, 7), codes, strict=True):
        cost, audit, _ = solve([(names[c % 4], "", faults[c // 4]) for c in code])
        assert (found[0], op.LETTERS[found[1]].tobytes().decode()) == (cost, audit)
