"""Ordered per-key computations that do not put a whole key into one task.

A plain window partitioned by the key sorts all rows of the key in one task. For a key with many rows the order is
first cut into buckets (expressions that never decrease along the order, such as the minute of a timestamp), each
bucket is computed on its own, and only one summary row per bucket is ordered within the key.

Keys with few rows need none of that: ``split_hot`` sets them apart, and they take one window over one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys are counted in slots, so that the counts have a bounded size; a key cannot have more rows than its slot.
SLOTS = 1 << 16
# Rows of a key that one task may sort.
KEY_ROWS = 1_000_000


def split_hot(df: DataFrame, keys: Sequence[str], key_rows: int = KEY_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose keys have at most ``key_rows`` rows each, and the others (None without any).

    Runs one job over the key columns, so ``df`` should be a stored table. Keys that share a slot with a hot one count as
    hot, too, which costs time but changes no result. The driver gets at most ``SLOTS`` numbers.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    counts = df.groupBy(slot.alias("slot")).count().where(F.col("count") > key_rows)
    hot = [r["slot"] for r in counts.select("slot").collect()]
    if not hot:
        return df, None
    return df.where(~slot.isin(hot)), df.where(slot.isin(hot))


def running_totals_of_stored(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    buckets: Sequence[Column],
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """:func:`running_totals` of a stored table, with buckets only for keys that have many rows."""
    few, many = split_hot(df, keys, key_rows)
    totals = running_totals(few, keys, order, values)
    if many is None:
        return totals
    return totals.unionByName(running_totals(many, keys, order, values, buckets))


def previous_value_of_stored(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, bucket: Column, key_rows: int = KEY_ROWS
) -> DataFrame:
    """:func:`previous_value` of a stored table, with buckets only for keys that have many rows."""
    few, many = split_hot(df, keys, key_rows)
    found = few.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    if many is None:
        return found
    return found.unionByName(previous_value(many, keys, order, value, out, bucket))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    buckets: Sequence[Column] = (),
) -> DataFrame:
    """Add one inclusive running sum per entry of ``values`` (output column: input column).

    ``order`` must be a total order within ``keys``; ``buckets`` go from coarse to fine.
    Key columns must not be null.
    """
    keys = list(keys)
    if not buckets:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(source).over(window).alias(out) for out, source in values.items()])
    bucket = f"_bucket{len(keys)}"
    staged = df.withColumn(bucket, buckets[0])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = {out: f"_carried_{out}" for out in values}
    offsets = (
        staged.groupBy(*keys, bucket)
        .agg(*[F.sum(source).alias(carried[out]) for out, source in values.items()])
        .select(
            *keys,
            bucket,
            *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in carried.values()],
        )
    )
    inner = running_totals(staged, [*keys, bucket], order, values, buckets[1:])
    return (
        inner.join(offsets, [*keys, bucket])
        .withColumns({out: F.col(out) + F.col(name) for out, name in carried.items()})
        .drop(bucket, *carried.values())
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, bucket: Column
) -> DataFrame:
    """Add the ``value`` of the preceding row of the same key, null for the first row.

    ``order`` must be unique within ``keys`` and ``bucket`` must not decrease along it.
    """
    keys = list(keys)
    staged = df.withColumn("_bucket", bucket).withColumn("_boxed", F.struct(F.col(value).alias("v")))
    within = Window.partitionBy(*keys, "_bucket").orderBy(order)
    last_before = (
        staged.groupBy(*keys, "_bucket")
        .agg(F.max_by("_boxed", order).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")))
        .drop("_last")
    )
    return (
        staged.withColumn("_inside", F.lag("_boxed").over(within))
        .join(last_before, [*keys, "_bucket"])
        .withColumn(out, F.coalesce("_inside", "_carried")["v"])
        .drop("_bucket", "_boxed", "_inside", "_carried")
    )
