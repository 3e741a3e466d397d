"""Keeping the relational tables current from the change feed, and moving them into order documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import sort_key
from ..schemas import (
    ADDRESS,
    BACKFILL_BATCH,
    BACKFILL_PAGE_FACTOR,
    ITEMS,
    LEGACY_DELETED,
    LEGACY_ITEM_COLUMNS,
    LEGACY_ORDER_COLUMNS,
    ORDER_COLUMNS,
)

_REFRESHED = ("status", "payment_state", "updated_at")


def _flat(image: Column, column: str) -> Column:
    if column.startswith("shipping_"):
        return image["shipping_address"][column.removeprefix("shipping_")]
    return image[column]


def collapse_changes(changes: DataFrame) -> DataFrame:
    """One row per order with what replaying its records in ``seq`` order would leave behind.

    First and last image of the INSERT and MODIFY records, the number of the last of them, and number and
    time of the last REMOVE. Records without the image they need do nothing. All aggregates are partial, so
    an order with very many changes is reduced before the shuffle.
    """
    new, old = F.col("new_image"), F.col("old_image")
    written = F.col("op").isin("INSERT", "MODIFY") & new.isNotNull()
    removed = (F.col("op") == "REMOVE") & old.isNotNull()
    write_seq, remove_seq = F.when(written, F.col("seq")), F.when(removed, F.col("seq"))
    light = new.dropFields("items", "order_ts_id", "order_ts", "idempotency_key", "ttl")
    return (
        changes.where(written | removed)
        .withColumn("_light", light)
        .groupBy(F.coalesce(new["order_id"], old["order_id"]).alias("order_id"))
        .agg(
            F.min_by("_light", write_seq).alias("first_image"),
            F.max_by(F.struct(*[new[c].alias(c) for c in _REFRESHED]), write_seq).alias("last_state"),
            F.max(write_seq).alias("last_write"),
            F.max(remove_seq).alias("last_remove"),
            F.max_by("changed_at", remove_seq).alias("removed_at"),
        )
    )


def upsert_orders(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a change feed to the flat orders table.

    A known order gets status, payment state and update time of its last image. A new one takes its other
    columns from its first image. A REMOVE after the last image marks an order that exists as deleted.
    """
    marked = target.select(F.col("order_id"), F.struct(*LEGACY_ORDER_COLUMNS).alias("_row"))
    joined = marked.join(collapse_changes(changes), "order_id", "full_outer")
    row, first, state = F.col("_row"), F.col("first_image"), F.col("last_state")
    exists = row.isNotNull() | F.col("last_write").isNotNull()
    deleted = F.col("last_remove").isNotNull() & (
        F.col("last_write").isNull() | (F.col("last_remove") > F.col("last_write"))
    )

    def value(column: str) -> Column:
        if column == "order_id":
            return F.col("order_id")
        if column not in _REFRESHED:
            return F.when(row.isNotNull(), row[column]).otherwise(_flat(first, column))
        current = F.when(F.col("last_write").isNotNull(), state[column]).otherwise(row[column])
        if column == "status":
            return F.when(deleted, F.lit(LEGACY_DELETED)).otherwise(current)
        if column == "updated_at":
            return F.when(deleted, F.col("removed_at")).otherwise(current)
        return current

    return joined.where(exists).select(*[value(c).alias(c) for c in LEGACY_ORDER_COLUMNS])


def upsert_items(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a change feed to the flat items table: refresh quantity and prices, add new lines, drop none."""
    item = F.col("item")
    lines = (
        changes.where(F.col("op").isin("INSERT", "MODIFY") & F.col("new_image").isNotNull())
        .select(F.col("new_image.order_id").alias("order_id"), "seq", F.explode("new_image.items").alias("item"))
        .groupBy("order_id", item["sku"].alias("sku"))
        .agg(
            F.min_by(item["name"], "seq").alias("_name"),
            F.max_by(
                F.struct(item["quantity"].alias("quantity"), item["unit_price"].alias("unit_price"),
                         item["total_price"].alias("total_price")),
                "seq",
            ).alias("_last"),
        )
    )
    joined = target.select(*LEGACY_ITEM_COLUMNS).join(lines, ["order_id", "sku"], "full_outer")
    last = F.col("_last")
    return joined.select(
        "order_id",
        "sku",
        F.coalesce("name", "_name").alias("name"),
        *[F.when(last.isNotNull(), last[c]).otherwise(F.col(c)).alias(c)
          for c in ("quantity", "unit_price", "total_price")],
    )


def soft_delete(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Mark the orders of REMOVE records as deleted; unknown orders are ignored."""
    removed = (
        changes.where((F.col("op") == "REMOVE") & F.col("old_image").isNotNull())
        .groupBy(F.col("old_image.order_id").alias("order_id"))
        .agg(F.max("changed_at").alias("_removed_at"))
    )
    gone = F.col("_removed_at").isNotNull()
    return target.join(removed, "order_id", "left").select(
        *[
            F.when(gone, F.lit(LEGACY_DELETED)).otherwise(F.col(c)).alias(c) if c == "status"
            else F.coalesce("_removed_at", c).alias(c) if c == "updated_at"
            else F.col(c)
            for c in target.columns
        ]
    )


# ---- backfill ------------------------------------------------------------------------------------------


def not_deleted(orders: DataFrame) -> DataFrame:
    """Rows with a status other than deleted; a null status is dropped as well."""
    return orders.where(F.col("status") != LEGACY_DELETED)


def nest_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order documents from the flat tables, one for each order. No items give an empty array."""
    nested = items.groupBy("order_id").agg(
        F.sort_array(F.collect_list(F.struct("sku", "name", "quantity", "unit_price", "total_price")))
        .cast(ITEMS).alias("items")
    )
    joined = not_deleted(orders).join(nested, "order_id", "left")
    address = F.struct(*[F.col(f"shipping_{p}").alias(p) for p in ("street", "city", "state", "zip")])
    return joined.select(
        "customer_id",
        sort_key(F.col("created_at"), F.col("order_id")).alias("order_ts_id"),
        "order_id",
        F.col("created_at").alias("order_ts"),
        "store_id",
        "county_id",
        "status",
        "payment_state",
        F.coalesce("items", F.array().cast(ITEMS)).alias("items"),
        F.col("subtotal").try_cast("decimal(18,2)").alias("subtotal"),
        F.col("tax").try_cast("decimal(21,4)").alias("tax"),
        F.col("total").try_cast("decimal(23,4)").alias("total"),
        address.cast(ADDRESS).alias("shipping_address"),
        F.concat(F.lit("backfill-"), "order_id").alias("idempotency_key"),
        "created_at",
        "updated_at",
        F.lit(None).cast("bigint").alias("ttl"),
    ).select(*ORDER_COLUMNS)


def page_size(batch: int | None = None) -> int:
    return (batch or BACKFILL_BATCH) * BACKFILL_PAGE_FACTOR


def backfill_page(orders: DataFrame, items: DataFrame, after: str | None, limit: int) -> DataFrame:
    """The next ``limit`` orders after an id, in id order, as documents."""
    rows = not_deleted(orders)
    if after is not None:
        rows = rows.where(F.col("order_id") > after)
    page = rows.orderBy("order_id").limit(limit)
    return nest_orders(page, items.join(page.select("order_id"), "order_id", "left_semi"))


def progress_after(page: DataFrame, progress: dict[str, object], limit: int, as_of: Column) -> DataFrame:
    """One progress row after a page: COMPLETED when the page is empty, else IN_PROGRESS with the new position."""
    rows = F.count(F.lit(1))
    done = F.lit(progress.get("total_processed") or 0).cast("bigint")
    last = F.lit(progress.get("last_processed_id")).cast("string")
    return page.agg(rows.alias("n"), F.max("order_id").alias("last")).select(
        F.when(F.col("n") == 0, "COMPLETED").otherwise("IN_PROGRESS").alias("status"),
        F.coalesce("last", last).alias("last_processed_id"),
        (done + F.col("n")).alias("total_processed"),
        F.col("n").alias("processed_in_this_run"),
        (F.col("n") == limit).alias("has_more"),
        as_of.alias("updated_at"),
    )
