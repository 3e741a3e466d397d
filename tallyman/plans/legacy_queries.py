"""Queries: relational upserts and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import legacy
from ..schemas import ITEMS, LEGACY_ITEM_COLUMNS, LEGACY_ORDER_COLUMNS
from ..sources import model
from .access_queries import shown, shown_all
from .registry import query

AFTER = "ORD-" + "0" * 17 + "500" + "0" * 6


def _changes(spark: SparkSession, sf_dir: str, items: bool = True) -> DataFrame:
    """The feed of the orders with ``orderkey % 3 <> 0``, so that some flat rows stay untouched.

    A flat order holds totals but no items. Without ``items`` the images have none, and none are nested and shuffled.
    """
    source = model.orders(spark, sf_dir).where(F.col("orderkey") % 3 != 0)
    if not items:
        source = source.withColumn("items", F.lit(None).cast(ITEMS))
    return model.changes(spark, sf_dir, source)


_FLAT = ("street AS shipping_street, city AS shipping_city, state AS shipping_state, zip AS shipping_zip")
_LEGACY_SQL = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" if c in ("subtotal", "tax", "total") else c for c in LEGACY_ORDER_COLUMNS
)


def _after_feed(removes: bool) -> str:
    """All flat orders after the feed, optionally with the REMOVE records applied."""
    gone = "orderkey % 97 = 0" if removes else "false"
    return f"""
SELECT {_LEGACY_SQL} FROM (
  SELECT order_id, customer_id, store_id, county_id, CASE WHEN {gone} THEN 'DELETED' ELSE status END AS status,
         payment_state, subtotal, tax, total, {_FLAT}, created_at,
         created_at + to_minutes(CASE WHEN {gone} THEN 6 WHEN orderkey % 11 = 0 THEN 4 ELSE 3 END) AS updated_at
  FROM orders_v WHERE orderkey % 3 <> 0
  UNION ALL
  SELECT {", ".join(LEGACY_ORDER_COLUMNS)} FROM legacy_orders_v WHERE orderkey % 3 = 0)
"""


@query("legacy_upsert_orders", ("orders_v", "legacy_orders_v"), _after_feed(removes=False))
def legacy_upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _changes(spark, sf_dir, items=False).where(F.col("op") != "REMOVE")
    return shown_all(legacy.upsert_orders(model.legacy_orders(spark, sf_dir), feed), LEGACY_ORDER_COLUMNS)


@query("legacy_apply_changes", ("orders_v", "legacy_orders_v"), _after_feed(removes=True))
def legacy_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _changes(spark, sf_dir, items=False)
    return shown_all(legacy.upsert_orders(model.legacy_orders(spark, sf_dir), feed), LEGACY_ORDER_COLUMNS)


@query("legacy_upsert_items", ("lines_v", "legacy_items_v"), """
SELECT order_id, sku, CASE WHEN orderkey % 2 = 0 THEN 'legacy ' ELSE '' END || name AS name, quantity,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_price AS DOUBLE) AS total_price
FROM lines_v WHERE orderkey % 3 <> 0
UNION ALL
SELECT order_id, sku, name, quantity, CAST(unit_price AS DOUBLE), CAST(total_price AS DOUBLE)
FROM legacy_items_v WHERE orderkey % 3 = 0
""")
def legacy_upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = legacy.upsert_items(model.legacy_items(spark, sf_dir), _changes(spark, sf_dir))
    return merged.select(
        *[F.col(c).cast("double").alias(c) if c in ("unit_price", "total_price") else c for c in LEGACY_ITEM_COLUMNS]
    )


@query("legacy_soft_delete", ("orders_v", "legacy_orders_v"), """
SELECT order_id, CASE WHEN orderkey % 97 = 0 AND orderkey % 3 <> 0 THEN 'DELETED' ELSE status END AS status,
       CASE WHEN orderkey % 97 = 0 AND orderkey % 3 <> 0 THEN created_at + INTERVAL 6 MINUTE ELSE updated_at END AS updated_at
FROM legacy_orders_v
""")
def legacy_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = legacy.soft_delete(model.legacy_orders(spark, sf_dir), _changes(spark, sf_dir, items=False))
    return marked.select("order_id", "status", "updated_at")


_DOCUMENTS = """
, items_text_v AS (
  SELECT order_id, string_agg(sku || ':' || quantity || ':' || total_price, ',' ORDER BY sku) AS items
  FROM legacy_items_v GROUP BY order_id)
SELECT o.order_id, customer_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '.000Z#' || o.order_id AS order_ts_id,
       status, coalesce(items, '') AS items, CAST(total AS DOUBLE) AS total,
       shipping_street || '|' || shipping_city || '|' || shipping_state || '|' || shipping_zip AS shipping_address,
       'backfill-' || o.order_id AS idempotency_key, created_at AS order_ts
FROM legacy_orders_v o LEFT JOIN items_text_v i ON i.order_id = o.order_id
WHERE status <> 'DELETED'
"""
_DOCUMENT_COLUMNS = ("order_id", "customer_id", "order_ts_id", "status", "items", "total", "shipping_address",
                     "idempotency_key", "order_ts")


@query("backfill_nested_orders", ("legacy_orders_v", "legacy_items_v"), _DOCUMENTS)
def backfill_nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = legacy.nest_orders(model.legacy_orders(spark, sf_dir), model.legacy_items(spark, sf_dir))
    return shown_all(nested, _DOCUMENT_COLUMNS)


@query("backfill_page", ("legacy_orders_v", "legacy_items_v"), _DOCUMENTS + f"""
AND o.order_id > '{AFTER}' ORDER BY o.order_id LIMIT 250
""")
def backfill_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = legacy.backfill_page(
        model.legacy_orders(spark, sf_dir), model.legacy_items(spark, sf_dir), AFTER, legacy.page_size()
    )
    return shown_all(page, _DOCUMENT_COLUMNS)


@query("backfill_progress", ("legacy_orders_v", "as_of_v"), f"""
SELECT CASE WHEN n = 0 THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status, coalesce(last, '{AFTER}') AS last_processed_id,
       239 + n AS total_processed, n AS processed_in_this_run, n = 250 AS has_more, as_of AS updated_at
FROM (SELECT count(*) AS n, max(order_id) AS last FROM (
        SELECT order_id FROM legacy_orders_v WHERE status <> 'DELETED' AND order_id > '{AFTER}'
        ORDER BY order_id LIMIT 250)), as_of_v
""")
def backfill_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = legacy.page_size()
    before = {"status": "IN_PROGRESS", "last_processed_id": AFTER, "total_processed": 239}
    page = legacy.backfill_page(model.legacy_orders(spark, sf_dir), model.legacy_items(spark, sf_dir), AFTER, limit)
    return legacy.progress_after(page, before, limit, model.latest_order_time(spark, sf_dir))
