"""Repair of damaged conversations by the cheapest edits, the least of equally cheap ones.

A conversation's rows, in order, are kept (0), given the role ``user`` or ``assistant`` (3) or deleted (4), and empty
messages of either role may be inserted anywhere (3), so that the roles' initials read ``(s?(ua)+)?``. A row that is left
truncated costs 3 more; blank rows and repetitions must go. The edits' initials are the audit.

*Cost.* What is left to pay after a row depends on the row and one of four states, so each row is a 4 x 4 matrix of
costs. Products of 1, 2, 4, ... neighbouring matrices (sums and minima) give the costs from every row to the end.

*Path.* An edit that pays exactly the difference of two such costs is an optimal arc. Nodes are ranked by the first 1, 2, 4, ...
letters of their audit: a node's next rank comes from its rank and that of the node which a doubled pointer reaches.
Of a node's optimal arcs that with the least letter and then the least rank of its target is taken; the doubled pointers
then list the nodes of the path. No two arcs of a node share a letter here, so the least audit is the only one of its kind
and fixes the repaired messages.

*Scale.* The rows of all conversations are sorted by a range partitioning and cut into blocks; texts stay behind as digests.
A conversation meets in one task as one byte for each row, as its audit does in the result; the steps above run on
stretches of ``STRETCH`` rows, many short conversations at a time. Identical rows are counted before the shuffle. The
repaired text is hashed as a stream in sorted order, so no conversation is held as text.

Definitions: null roles and texts are one space, and so is a null in the text that damage is drawn from. A null
``conv_id`` is a conversation like others. Rows of one turn are ordered by role, then by the digest of their text;
identical rows are repetitions of the first. A role counts by its first character; one without a character is never kept. A
conversation without rows after damage has zeros, an empty audit and the hash of an empty text. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

STRETCH = 1 << 14
ROWS_AT_ONCE = 1 << 15
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = np.frombuffer(b"DIKR", np.uint8)
_SPACES = "\x20\t\n\x0b\x0c\r"

# ---- damage and faults ---------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with the number of their ``copies``; of dropped ones only the conversation is left (0 copies)."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    seed = F.concat_ws(":", text_of("conv_id"), text_of("turn"))
    kind = F.crc32(F.encode(seed, "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    there = kind != 0
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(there, F.col("turn").cast("long")).alias("turn"),
        F.when(there, F.when(kind == 4, "user").otherwise(text_of("role"))).otherwise("").alias("role"),
        F.when(there, text).otherwise("").alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _faults(rows: DataFrame) -> DataFrame:
    """One row for each different message of a turn: its digest, initial, fault (0 none, 1 truncated, 2 blank) and copies."""
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACES))
    initial = F.left("role", F.lit(1))
    light = rows.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("copies") > 0, _digest(F.col("text"))).otherwise(F.lit(b"")).alias("digest"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        F.when(trimmed == "", 2).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1).alias("fault"),
        "copies",
    )
    return light.groupBy("conv_id", "turn", "role", "digest", "initial", "fault").agg(F.sum("copies").alias("copies"))


def _ordered(light: DataFrame) -> DataFrame:
    """Mark repetitions of earlier turns (fault 3) and sort everything by conversation and place."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = light.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(
        F.min(place).alias("_first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    later = (F.col("fault") != 2) & (F.col("_first") < place)
    marked = light.join(first, same).select(
        "conv_id", "turn", "role", "digest", "copies", "initial", F.when(later, 3).otherwise(F.col("fault")).alias("fault")
    )
    order = ("conv_id", "turn", "role", "digest")
    marked = cut_lineage(marked, "faults")
    parts = max(1, int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)


_BLOCK = (
    "conv_id long, block long, codes binary, copies array<long>, low long, high long, turns long, "
    "messages array<struct<turn:long,role:string,digest:binary>>"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row for each conversation of a batch: a code for each message, and the range of its turns."""
    number = TaskContext.get().partitionId() << 40
    message = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())])
    for batch in batches:
        if not len(batch):
            continue
        column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
        n = len(batch)
        ids, turns = column("conv_id"), column("turn")
        id_numbers, no_id = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        opens = np.ones(n, bool)
        opens[1:] = (id_numbers[1:] != id_numbers[:-1]) | (no_id[1:] != no_id[:-1])
        starts = np.flatnonzero(opens)
        offsets = np.append(starts, n).astype(np.int32)
        codes = (column("initial").to_numpy() + 4 * column("fault").to_numpy()).astype(np.uint8)
        copies = column("copies").to_numpy()
        turn, known = pc.fill_null(turns, 0).to_numpy(), turns.is_valid().to_numpy(zero_copy_only=False)
        known = known & (copies > 0)
        some = np.add.reduceat(known, starts) > 0
        low = np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), starts)
        high = np.maximum.reduceat(np.where(known, turn, np.iinfo(np.int64).min), starts)
        new = known.copy()
        new[1:] &= opens[1:] | ~known[:-1] | (turn[1:] != turn[:-1])
        messages = pa.StructArray.from_arrays([turns, column("role"), column("digest")], fields=list(message))
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": ids.take(pa.array(starts)),
                "block": pa.array(np.arange(number, number + len(starts))),
                "codes": pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(codes)]),
                "copies": pa.ListArray.from_arrays(pa.array(offsets), pa.array(copies, pa.int64())),
                "low": pa.array(low, mask=~some),
                "high": pa.array(high, mask=~some),
                "turns": pa.array(np.add.reduceat(new, starts).astype(np.int64)),
                "messages": pa.ListArray.from_arrays(pa.array(offsets), messages),
            }
        )
        number += len(starts)


# ---- cost and path -------------------------------------------------------------------------------------------------

# States: 0 nothing yet, 1 after the system message, 2 after a user's, 3 after an assistant's message.
_NEVER = 1 << 40
_INSERTED = np.array([2, 2, 3, 2])
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_END, _LAST = 16, 17  # behind a stretch, behind a conversation


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state of each edit (in the order of ``LETTERS``) by code and state."""
    cost = np.full((18, 4, 4), _NEVER)
    to = np.zeros((18, 4, 4), np.int64)
    to[:, :, 0], to[:, :, 1], to[:, :, 3] = np.arange(4), _INSERTED, _INSERTED
    cost[:16, :, 0] = DELETE
    cost[:16, :, 1] = cost[_LAST, :, 1] = INSERT
    for code in range(8):  # others are blank or repeated
        left = TRUNCATED * (code // 4)
        cost[code, :, 3] = REROLE + left
        for state in range(4):
            if (state, code % 4) in _KEPT:
                cost[code, state, 2] = KEEP + left
                to[code, state, 2] = _KEPT[state, code % 4]
    return cost, to


_COST, _TO = _arcs()


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    found = a[:, :, 0, None] + b[:, 0, None, :]
    for k in range(1, 4):
        np.minimum(found, a[:, :, k, None] + b[:, k, None, :], out=found)
    return np.minimum(found, _NEVER)


def _steps() -> np.ndarray:
    """For each code the cost from state to state over any inserts and then the row itself."""
    nothing = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    insert = nothing.copy()
    insert[np.arange(4), _INSERTED] = INSERT
    inserts = _product(insert[None], insert[None])  # two at most: a third would undo the first
    table = np.repeat(nothing[None], 18, axis=0)
    for code in range(16):
        row = np.full((4, 4), _NEVER)
        for letter in (0, 2, 3):
            at = (np.arange(4), _TO[code, :, letter])
            row[at] = np.minimum(row[at], _COST[code, :, letter])
        table[code] = _product(inserts, row[None])[0]
    return table


_STEP = _steps()
_ACCEPTED = np.array([0, 2 * INSERT, INSERT, 0])  # what is left to pay behind the last row


def costs_to_end(codes: np.ndarray, ends: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What is left to pay from each place and state; ``ends`` are the stretches' last places, ``after`` their costs."""
    size = np.diff(np.concatenate([[-1], ends]))
    stretch = np.repeat(np.arange(len(ends)), size)
    end = ends[stretch]
    matrix = _STEP[codes]
    reach = 1
    while reach < size.max(initial=0):
        far = np.flatnonzero(np.arange(len(codes)) + reach <= end)
        matrix[far] = _product(matrix[far], matrix[far + reach])
        reach *= 2
    return np.minimum((matrix + after[stretch][:, None, :]).min(axis=2), _NEVER)


def least_paths(codes: np.ndarray, costs: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least optimal path from each entry node (``4 * place + state``).

    Returns the nodes on all paths one after the other, the letter (0 to 3) of each, the paths' lengths and last nodes.
    """
    places = len(codes)
    paid = costs.ravel()
    ahead = np.minimum(np.arange(places)[:, None, None] + np.array([1, 0, 1, 1]), places - 1)
    target = 4 * ahead + _TO[codes]
    optimal = (_COST[codes] + paid[target] == costs[:, :, None]).reshape(4 * places, 4)
    target = target.reshape(4 * places, 4)
    nodes = np.arange(4 * places)
    ended = ~optimal.any(axis=1)
    letter = np.where(ended, 0, 1 + optimal.argmax(axis=1))
    pointer = np.where(ended, nodes, target[nodes, np.maximum(letter - 1, 0)])
    pointers, rank, length = [pointer], letter, (~ended).astype(np.int64)
    while True:
        reached = pointers[-1]
        if ended[reached].all():
            break
        _, rank = np.unique(rank * np.int64(len(nodes) + 5) + rank[reached], return_inverse=True)
        length = length + length[reached]
        pointers.append(reached[reached])
    # The arc with the least letter, then the least rank of what follows.
    worth = np.where(optimal, np.arange(4) * np.int64(len(nodes) + 5) + rank[target], _NEVER << 20)
    letter = worth.argmin(axis=1)
    sizes = length[entries]
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    path = np.repeat(entries, sizes)
    for k, reached in enumerate(pointers):
        path = np.where(step >> k & 1, reached[path], path)
    return path, letter[path], sizes, pointers[-1][entries]


def repaired(conversations: list[np.ndarray], stretch: int = STRETCH) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Cost of each conversation (a code for each row), and the edits in order: letter, row and state before it."""
    parts = [[c[i : i + stretch] for i in range(0, max(1, len(c)), stretch)] for c in conversations]

    def together(chosen: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        pieces = []
        for c, k in chosen:
            pieces += [parts[c][k], np.array([_LAST if k == len(parts[c]) - 1 else _END], np.uint8)]
        ends = np.cumsum([len(parts[c][k]) + 1 for c, k in chosen]) - 1
        return np.concatenate(pieces), ends

    after = [[_ACCEPTED] * len(p) for p in parts]
    total = [0] * len(parts)
    for back in range(max(map(len, parts), default=0)):
        chosen = [(c, len(p) - 1 - back) for c, p in enumerate(parts) if back < len(p)]
        codes, ends = together(chosen)
        costs = costs_to_end(codes, ends, np.array([after[c][k] for c, k in chosen]))
        for (c, k), low in zip(chosen, np.append(0, ends[:-1] + 1), strict=True):
            if k:
                after[c][k - 1] = costs[low]
            else:
                total[c] = int(costs[low, 0])
    state = [0] * len(parts)
    edits: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in parts]
    for k in range(max(map(len, parts), default=0)):
        chosen = [(c, k) for c, p in enumerate(parts) if k < len(p)]
        codes, ends = together(chosen)
        lows = np.append(0, ends[:-1] + 1)
        costs = costs_to_end(codes, ends, np.array([after[c][k] for c, _ in chosen]))
        path, letter, sizes, last = least_paths(codes, costs, 4 * lows + np.array([state[c] for c, _ in chosen]))
        cut = np.cumsum(sizes)[:-1]
        for (c, _), low, nodes, letters, at in zip(chosen, lows, np.split(path, cut), np.split(letter, cut), last, strict=True):
            edits[c].append((letters, nodes // 4 - low + k * stretch, nodes % 4))
            state[c] = int(at % 4)
    return [(t, *(np.concatenate(x) for x in zip(*e, strict=True))) for t, e in zip(total, edits, strict=True)]


# ---- conversations -------------------------------------------------------------------------------------------------

_ROLES = ("user", "assistant")
_EDITS = (
    "conv_id long, block long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "tail array<string>, kept array<struct<place:int,as_role:string,before:array<string>>>"
)
_EDIT_TYPE = pa.schema(
    [
        ("conv_id", pa.int64()), ("block", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
        ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
        ("tail", pa.list_(pa.string())),
        ("kept", pa.list_(pa.struct([("place", pa.int32()), ("as_role", pa.string()), ("before", pa.list_(pa.string()))]))),
    ]
)


class _Conversation:
    """The blocks of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.blocks: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.low = self.high = self.end = None
        self.turns = self.rows = 0

    def add(self, row: dict) -> None:
        codes, copies = np.frombuffer(row["codes"], np.uint8), np.array(row["copies"], np.int64)
        self.blocks.append((row["block"], codes, copies))
        self.rows += int(copies.sum())
        if row["low"] is not None:
            self.turns += row["turns"] - (self.end == row["low"])  # a turn may be cut by the border of two blocks
            self.low = row["low"] if self.low is None else self.low
            self.high = self.end = row["high"]

    def expanded(self) -> np.ndarray:
        """A code for each row; copies of a row behind the first are repetitions."""
        codes = np.concatenate([c for _, c, _ in self.blocks])
        copies = np.concatenate([n for _, _, n in self.blocks])
        if (copies == 1).all():
            return codes
        found = np.repeat(codes, copies)
        again = np.ones(len(found), bool)
        again[(np.cumsum(copies) - copies)[copies > 0]] = False
        again &= found // 4 < 2
        found[again] = found[again] % 4 + 12
        return found

    def result(self, codes: np.ndarray, cost: int, letters: np.ndarray, rows: np.ndarray, states: np.ndarray) -> Iterator[dict]:
        faults = np.bincount(codes // 4, minlength=4)
        pair = codes[:-1] % 4 * 4 + codes[1:] % 4
        legal = np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
        # Inserted messages go with the next row that stays, or with the end.
        stays, inserted = np.flatnonzero(letters >= 2), np.flatnonzero(letters == 1)
        owner = np.searchsorted(stays, inserted)
        before: dict[int, list[str]] = {}
        for at, state in zip(owner.tolist(), states[inserted].tolist(), strict=True):
            before.setdefault(at, []).append(_ROLES[_INSERTED[state] - 2])
        yield {
            "conv_id": self.conv_id, "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "blank": int(faults[2]), "duplicate": int(faults[3]), "truncated": int(faults[1]),
            "illegal": int((~legal).sum()), "cost": cost, "audit": LETTERS[letters].tobytes().decode(),
            "tail": before.get(len(stays), []),
        }
        copies = np.concatenate([n for _, _, n in self.blocks])
        message = np.repeat(np.arange(len(copies)), copies)[rows[stays]]
        as_role = np.where(letters[stays] == 2, 2, _INSERTED[states[stays]] - 2)
        low = first = 0
        for block, codes_of, _ in self.blocks:
            last = int(np.searchsorted(message, low + len(codes_of)))
            yield {
                "conv_id": self.conv_id, "block": block,
                "kept": [
                    {"place": int(message[i]) - low, "as_role": (*_ROLES, None)[as_role[i]], "before": before.get(i, [])}
                    for i in range(first, last)
                ],
            }
            low, first = low + len(codes_of), last


def _repair(stretch: int):
    def solved(waiting: list[_Conversation]) -> pa.RecordBatch:
        codes = [c.expanded() for c in waiting]
        rows = [
            row
            for conversation, code, edits in zip(waiting, codes, repaired(codes, stretch), strict=True)
            for row in conversation.result(code, *edits)
        ]
        return pa.RecordBatch.from_pylist(rows, schema=_EDIT_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[_Conversation] = []
        for batch in batches:
            for row in batch.to_pylist():
                if not waiting or waiting[-1].conv_id != row["conv_id"]:
                    if sum(c.rows + 1 for c in waiting) >= ROWS_AT_ONCE:
                        yield solved(waiting)
                        waiting = []
                    waiting.append(_Conversation(row["conv_id"]))
                waiting[-1].add(row)
        if waiting:
            yield solved(waiting)

    return run


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a conversation's summary, then each message's edit followed by its text) to results."""
    done: list[dict] = []
    summary, digest, lines, edit = None, hashlib.sha256(), 0, None

    def line(role: str, text: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + role + ":").encode())
        digest.update(text.encode())
        lines += 1

    def close() -> None:
        if summary is not None:
            for role in summary["tail"]:
                line(role, "")
            done.append({**{k: summary[k] for k in ("conv_id", *_COUNTS, "audit")}, "repaired_sha256": digest.hexdigest()})

    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                close()
                summary, digest, lines, edit = row, hashlib.sha256(), 0, None
            elif row["kind"] == 1:
                edit = row
            elif edit is not None and (edit["turn"], edit["role"], edit["digest"]) == (row["turn"], row["role"], row["digest"]):
                for role in edit["before"]:
                    line(role, "")
                line(edit["as_role"] or row["role"], row["text"])
                edit = None
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    close()
    yield pa.RecordBatch.from_pylist(done, schema=schema)


def repair(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Repair conversations; ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` (see :func:`damaged`).

    Columns: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256`` (of the lines ``role:text``).
    """
    blocks = cut_lineage(_ordered(cut_lineage(_faults(rows), "messages")).mapInArrow(_blocks, _BLOCK), "blocks")
    # Codes are small and costly, so their tasks are not merged by size.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = blocks.drop("messages").repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "block")
    edits = cut_lineage(light.mapInArrow(_repair(stretch), _EDITS), "edits")

    nothing = {"turn": "long", "role": "string", "digest": "binary", "as_role": "string", "before": "array<string>", "text": "string",
               "audit": "string", "tail": "array<string>", **dict.fromkeys(_COUNTS, "long")}

    def row(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        columns = [given[c].alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
        return df.select("conv_id", F.lit(kind).alias("kind"), *columns)

    named = lambda *names: {n: F.col(n) for n in names}
    summaries = row(edits.filter("block IS NULL"), 0, role=F.lit(""), digest=F.lit(b""), **named("audit", "tail", *_COUNTS))
    kept = edits.filter("block IS NOT NULL AND size(kept) > 0").select("block", "kept").join(blocks.select("conv_id", "block", "messages"), "block")
    kept = kept.select("conv_id", F.explode(F.expr("transform(kept, k -> struct(messages[k.place] AS m, k AS k))")).alias("e"))
    decided = row(kept, 1, turn=F.col("e.m.turn"), role=F.col("e.m.role"), digest=F.col("e.m.digest"),
                  as_role=F.col("e.k.as_role"), before=F.col("e.k.before"))
    texts = rows.filter((F.col("copies") > 0) & (F.rtrim(F.col("text"), F.lit(_SPACES)) != ""))
    texts = row(texts, 2, digest=_digest(F.col("text")), **named("turn", "role", "text"))
    together = summaries.unionByName(decided).unionByName(texts)
    streamed = together.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "kind")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return streamed.mapInArrow(_hash, f"conv_id long, {counts}, audit string, repaired_sha256 string")
