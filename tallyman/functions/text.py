"""Null, text and time conventions of loosely typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAKE_TIME = "yyyy-MM-dd HH:mm:ss.SSS"


def filled(value: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(value, F.lit(""))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[filled(value) for value in values])


def lake_time(text: Column) -> Column:
    """Lake rendering of a time text; text that is not a time passes through unchanged."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), LAKE_TIME), text)


def items_text(items: Column) -> Column:
    """Readable one-line form of an items array: ``sku:quantity:total_price`` joined by commas."""
    parts = F.transform(
        items,
        lambda x: F.concat_ws(
            ":", x["sku"], x["quantity"].cast("string"), x["total_price"].cast("decimal(18,2)").cast("string")
        ),
    )
    return F.when(items.isNotNull(), F.array_join(parts, ","))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read instead of computing it again.

    The optimizer copies a plain projection into every filter above it; for parsed JSON that would parse
    each text many times. It does not look through a generator, so the value goes through a one-element one.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
