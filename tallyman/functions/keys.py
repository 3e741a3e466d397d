"""Keys and identifiers: order sort keys, stock keys, sortable ids, expiry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 32 digits of sortable ids, and the digits Spark's conv() uses for base 32.
ID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def iso_millis(ts: Column) -> Column:
    """UTC ISO-8601 text with milliseconds; text order equals time order."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def sort_key(ts: Column, order_id: Column) -> Column:
    """``<iso time>#<order id>``."""
    return F.concat(iso_millis(ts), F.lit("#"), order_id)


def sort_key_parts(key: Column) -> tuple[Column, Column]:
    """Time text and order id of a sort key; null where the part is missing."""
    parts = F.split(key, "#")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def store_sku(store_id: Column, sku: Column) -> Column:
    return F.concat(store_id, F.lit("#"), sku)


def expires_at_epoch(as_of: Column, minutes: int) -> Column:
    """Epoch seconds ``minutes`` after ``as_of``."""
    return F.unix_timestamp(as_of) + F.lit(minutes * 60)


def _base32(value: Column, width: int, base: int = 10) -> Column:
    digits = F.conv(value.cast("string"), base, 32)
    return F.translate(F.lpad(digits, width, "0"), CONV_DIGITS, ID_DIGITS)


def sortable_id(prefix: str, ts: Column, *key: Column) -> Column:
    """Time-ordered id: prefix, ten digits of milliseconds, sixteen digits (80 bits) from the key.

    The tail comes from the MD5 of the key's texts instead of a random draw, so a re-run task gives the same id.
    """
    digest = F.md5(F.concat_ws("#", *[k.cast("string") for k in key]).cast("binary"))
    high, low = F.substring(digest, 1, 10), F.substring(digest, 11, 10)
    return F.concat(F.lit(prefix), _base32(F.unix_millis(ts), 10), _base32(high, 8, 16), _base32(low, 8, 16))


def id_time(value: Column) -> Column:
    """The time that a sortable id was made for; null for other texts."""
    digits = F.translate(F.regexp_extract(value, "^[A-Z]+-([0-9A-Z]{10})[0-9A-Z]{16}$", 1), ID_DIGITS, CONV_DIGITS)
    return F.when(digits != "", F.timestamp_millis(F.conv(digits, 32, 10).cast("bigint")))


def is_order_id(value: Column) -> Column:
    return value.rlike("^ORD-[0-9A-Z]{26}$")


def is_uuid(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def is_customer_id(value: Column) -> Column:
    return F.length(value).between(1, 128)


def is_idempotency_key(value: Column) -> Column:
    return F.coalesce(F.length(value).between(8, 128), F.lit(False))


def is_iso_datetime(value: Column) -> Column:
    """UTC ISO datetime with optional fraction, and a real calendar time."""
    shape = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$")
    return shape & F.try_to_timestamp(value).isNotNull()
