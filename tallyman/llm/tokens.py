"""Words of a block of texts as numpy arrays: boundaries and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text handled at a time. A longer single text is a block of its own.
BLOCK_BYTES = 2 << 20
# Bytes hashed at a time; the work arrays take about 40 times as much.
_HASHED_BYTES = 1 << 20

def release_memory() -> None:
    """Give freed memory back to the system; Python workers live on after a task and share their machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


# What a byte becomes before words are cut at blanks.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN_WORDS = np.arange(256, dtype=np.uint8)
PLAIN_WORDS[9:14] = 32
LOWER_WORDS = PLAIN_WORDS[LOWER]
LETTER_WORDS = np.array([LOWER[b] if chr(LOWER[b]).isalnum() or b >= 128 else 32 for b in range(256)], np.uint8)

_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """``base ** 0, base ** 1, ...`` modulo 2**64; kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A hash of each slice ``codes[start:end]`` that does not depend on where the slice stands."""
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.multiply(codes, powers(base, len(codes)), out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(codes) + 1)
    return mixed((total[ends] - total[starts]) * inverse[starts])


class Words(NamedTuple):
    """Words of several texts in one buffer; ``bounds[d]:bounds[d + 1]`` are the words of text ``d``."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        found = np.empty(len(self.starts), np.uint64)
        low = 0
        while low < len(found):
            high = max(low + 1, int(np.searchsorted(self.ends, self.starts[low] + _HASHED_BYTES, "right")))
            first, last = self.starts[low], self.ends[high - 1]
            codes = _BYTE_CODES[self.buffer[first:last]]
            found[low:high] = range_hashes(codes, self.starts[low:high] - first, self.ends[low:high] - first)
            low = high
        return found

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split_words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = PLAIN_WORDS) -> Words:
    """Words between bytes that ``fold`` makes blank; the buffer then has one blank for each run of them."""
    codes = fold[data]
    blank = codes == 32
    first = np.zeros(len(codes) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    # A blank is kept only behind a word of the same text.
    before = np.empty(len(codes), bool)
    before[:1] = True
    before[1:] = blank[:-1]
    keep = ~(blank & (before | first))
    kept_before = np.zeros(len(codes) + 1, np.int32 if len(codes) < 2**31 else np.int64)
    np.cumsum(keep, out=kept_before[1:])
    if not keep.all():
        # A text whose leading blanks are gone starts at the next byte that is kept.
        codes, blank = codes[keep], blank[keep]
        first = np.zeros(len(codes) + 1, bool)
        first[kept_before[offsets]] = True
        first = first[:-1]
    word = ~blank
    opens = word.copy()
    opens[1:] &= blank[:-1] | first[1:]
    starts = np.flatnonzero(opens)
    closes = word.copy()
    closes[:-1] &= blank[1:] | first[1:]
    ends = np.flatnonzero(closes) + 1
    bounds = np.searchsorted(starts, kept_before[offsets])
    return Words(codes, starts, ends, bounds)


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``limit`` bytes of text; yields (first row, end row, bytes, offsets)."""
    values = batch.column(batch.schema.get_field_index(column))
    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    if not len(values):
        return
    buffers = values.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(values):
        high = int(np.searchsorted(ends, ends[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(values))
        yield low, high, data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high
