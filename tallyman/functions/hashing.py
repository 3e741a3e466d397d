"""Content hashes of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rolling_hash(text: Column) -> Column:
    """32-bit ``h * 31 + code unit`` over UTF-16 code units, absolute value, lower-case hex."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    positions = F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1)
    codes = F.when(F.length(units) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(positions, lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    )
    word = F.lit(0xFFFFFFFF)
    unsigned = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, code: (h * 31 + code).bitwiseAND(word))
    magnitude = F.when(unsigned >= (1 << 31), F.lit(1 << 32) - unsigned).otherwise(unsigned)
    return F.lower(F.conv(magnitude.cast("string"), 10, 16))


def request_hash(request: Column) -> Column:
    """SHA-256 over the canonical JSON of a parsed request: field order and spacing do not matter."""
    return F.sha2(F.to_json(request), 256)
