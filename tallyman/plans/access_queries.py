"""Queries: access patterns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import sort_key
from ..functions.text import items_text
from ..operators import access
from ..schemas import DETAIL_COLUMNS, LIST_COLUMNS, ORDER_BY_ID_COLUMNS
from ..sources import model
from .registry import query

COUNTY, STORE, STATUS = "COUNTY-007", "STORE-011", "PENDING"
CUSTOMER = "CUST-000000000007"
RANGE_START, RANGE_END = "1997-01-01 00:00:00", "1998-12-31 23:59:59"
# A page boundary inside that customer's history.
LAST_SEEN = "1999-01-01T00:00:00.000Z#ORD-" + "0" * 26


def shown(column: str) -> Column:
    """Output form of a column: money as double, nested values as text."""
    if column == "items":
        return items_text(F.col("items")).alias("items")
    if column == "shipping_address":
        a = F.col("shipping_address")
        return F.concat(
            a["street"], F.lit("|"), a["city"], F.lit("|"), a["state"], F.lit("|"), a["zip"]
        ).alias("shipping_address")
    if column in ("subtotal", "tax", "total"):
        return F.col(column).cast("double").alias(column)
    return F.col(column)


def shown_all(df: DataFrame, columns: tuple[str, ...], *extra: str) -> DataFrame:
    return df.select(*[shown(c) for c in (*columns, *extra)])


_SQL = {
    "items": "items_text AS items",
    "shipping_address": "street || '|' || city || '|' || state || '|' || zip AS shipping_address",
    "subtotal": "CAST(subtotal AS DOUBLE) AS subtotal",
    "tax": "CAST(tax AS DOUBLE) AS tax",
    "total": "CAST(total AS DOUBLE) AS total",
}


def sql_columns(columns: tuple[str, ...]) -> str:
    return ", ".join(_SQL.get(c, c) for c in columns)


_LIST_SQL = sql_columns(LIST_COLUMNS)


def _with_items(spark: SparkSession, sf_dir: str, heads: DataFrame, limit: int) -> DataFrame:
    """Items for the few heads a listing kept, cut to the limit again as documents."""
    return access.newest_first(model.documents(spark, sf_dir, heads, few=True), limit)


@query("county_orders_range", ("orders_v",), f"""
SELECT {_LIST_SQL}, order_ts FROM orders_v
WHERE county_id = '{COUNTY}' AND order_ts BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}'
ORDER BY order_ts DESC, order_id DESC LIMIT 100
""")
def county_orders_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (F.lit(t).cast("timestamp") for t in (RANGE_START, RANGE_END))
    heads = model.order_heads(spark, sf_dir, since=start)
    kept = access.county_orders(heads, COUNTY, start, end, tie="orderkey")
    return shown_all(_with_items(spark, sf_dir, kept, 100), LIST_COLUMNS, "order_ts")


@query("store_orders", ("orders_v",), f"""
SELECT {_LIST_SQL}, order_ts FROM orders_v WHERE store_id = '{STORE}'
ORDER BY order_ts DESC, order_id DESC LIMIT 100
""")
def store_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = access.store_orders(model.order_heads(spark, sf_dir), STORE, tie="orderkey")
    return shown_all(_with_items(spark, sf_dir, kept, 100), LIST_COLUMNS, "order_ts")


@query("status_queue", ("orders_v",), f"""
SELECT {_LIST_SQL}, order_ts FROM orders_v WHERE status = '{STATUS}'
ORDER BY order_ts DESC, order_id DESC LIMIT 100
""")
def status_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = access.status_queue(model.order_heads(spark, sf_dir, statuses=(STATUS,)), STATUS, tie="orderkey")
    return shown_all(_with_items(spark, sf_dir, kept, 100), LIST_COLUMNS, "order_ts")


def _history(spark: SparkSession, sf_dir: str, token: str | None) -> DataFrame:
    heads = model.order_heads(spark, sf_dir, customer_id=CUSTOMER)
    if token:
        # Heads up to the token's time; the exact boundary is applied to the documents below.
        last_time = access.parse_token(token)[1].split("#")[0]
        heads = heads.where(F.col("order_ts") <= F.lit(last_time).cast("timestamp"))
    # One head more than the page: the first one may hold only documents already seen.
    kept = access.newest_first(heads, access.check_limit(None) + 1, tie="orderkey")
    return access.customer_history(model.documents(spark, sf_dir, kept, few=True), CUSTOMER, token=token)


@query("customer_history", ("orders_v",), f"""
SELECT {_LIST_SQL}, order_ts_id FROM orders_v WHERE customer_id = '{CUSTOMER}'
ORDER BY order_ts_id DESC LIMIT 20
""")
def customer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_all(_history(spark, sf_dir, None), LIST_COLUMNS, "order_ts_id")


@query("customer_history_page2", ("orders_v",), f"""
SELECT {_LIST_SQL}, order_ts_id FROM orders_v
WHERE customer_id = '{CUSTOMER}' AND order_ts_id < '{LAST_SEEN}'
ORDER BY order_ts_id DESC LIMIT 20
""")
def customer_history_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = json.dumps({"customer_id": CUSTOMER, "order_ts_id": LAST_SEEN})
    return shown_all(_history(spark, sf_dir, token), LIST_COLUMNS, "order_ts_id")


@query("top_orders_per_county", ("orders_v",), """
SELECT * FROM (
  SELECT county_id, order_id, order_ts, status,
         CAST(row_number() OVER (PARTITION BY county_id ORDER BY order_ts DESC, order_id DESC) AS INTEGER) AS rank
  FROM orders_v) WHERE rank <= 5
""")
def top_orders_per_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = model.order_heads(spark, sf_dir).withColumn("order_id", model.order_id_of(F.col("orderkey")))
    ranked = access.top_per_group(heads.select("county_id", "order_id", "order_ts", "status"), "county_id", 5)
    return ranked.select("county_id", "order_id", "order_ts", "status", "rank")


@query("orders_by_ids", ("orders_v",), f"""
SELECT w.order_id, {sql_columns(DETAIL_COLUMNS[1:])}, o.order_id IS NOT NULL AS found
FROM (SELECT CASE WHEN o_orderkey % 49 = 0 THEN 'ORD-X' || lpad(CAST(o_orderkey AS VARCHAR), 25, '0')
             ELSE 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || '000000' END AS order_id
      FROM orders WHERE o_orderkey % 7 = 0) w
LEFT JOIN orders_v o ON o.order_id = w.order_id
""")
def orders_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = model.cancel_requests(spark, sf_dir).select("order_id")
    heads = model.order_heads(spark, sf_dir).withColumn("order_id", model.order_id_of(F.col("orderkey")))
    heads = heads.join(wanted, "order_id", "left_semi").drop("order_id")
    found = access.get_by_order_id(model.documents(spark, sf_dir, heads, selective=True), wanted)
    return shown_all(found, DETAIL_COLUMNS, "found")


@query("orders_by_composite_key", ("orders_v",), """
SELECT w.customer_id, w.order_ts_id, o.order_id, o.status, CAST(o.total AS DOUBLE) AS total,
       o.order_id IS NOT NULL AS found
FROM (SELECT customer_id, CASE WHEN orderkey % 30 = 0
                          THEN left(order_ts_id, 25) || 'ORD-X' || lpad(CAST(orderkey AS VARCHAR), 25, '0')
                          ELSE order_ts_id END AS order_ts_id
      FROM orders_v) w
LEFT JOIN orders_v o ON o.customer_id = w.customer_id AND o.order_ts_id = w.order_ts_id
""")
def orders_by_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = model.messages(spark, sf_dir).select("customer_id", "order_ts_id")
    heads = model.order_heads(spark, sf_dir)
    key = sort_key(F.col("order_ts"), model.order_id_of(F.col("orderkey")))
    heads = heads.withColumn("order_ts_id", key).join(wanted, ["customer_id", "order_ts_id"], "left_semi")
    # Nearly every order is wanted: lines restricted to them first would be sorted and summed whole in the same task.
    found = access.get_by_sort_key(model.documents(spark, sf_dir, heads.drop("order_ts_id")), wanted)
    return found.select("customer_id", "order_ts_id", "order_id", "status", shown("total"), "found")


@query("orders_live_ttl", ("orders_v", "as_of_v"), """
SELECT order_id, order_ts, ttl, CAST(epoch(as_of) AS BIGINT) + 1800 AS expiry_from_now
FROM orders_v, as_of_v WHERE ttl IS NULL OR ttl > epoch(as_of)
""")
def orders_live_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import expires_at_epoch

    as_of = model.latest_order_time(spark, sf_dir)
    heads = model.order_heads(spark, sf_dir).withColumn("order_id", model.order_id_of(F.col("orderkey")))
    return access.live_at(heads, as_of).select(
        "order_id", "order_ts", "ttl", expires_at_epoch(as_of, 30).alias("expiry_from_now")
    )


@query("orders_by_id_projection", ("orders_v",), f"SELECT {sql_columns(ORDER_BY_ID_COLUMNS)} FROM orders_v")
def orders_by_id_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_all(access.by_id_copy(model.orders(spark, sf_dir)), ORDER_BY_ID_COLUMNS)


@query("sort_key_roundtrip", ("heads_v",), """
SELECT order_id, strftime(order_ts, '%Y-%m-%dT%H:%M:%S') || '.000Z#' || order_id AS order_ts_id,
       strftime(order_ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS time_part, order_id AS id_part
FROM heads_v
""")
def sort_key_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import sort_key_parts

    heads = model.order_heads(spark, sf_dir).withColumn("order_id", model.order_id_of(F.col("orderkey")))
    keyed = heads.select("order_id", sort_key(F.col("order_ts"), F.col("order_id")).alias("order_ts_id"))
    time_part, id_part = sort_key_parts(F.col("order_ts_id"))
    return keyed.select("order_id", "order_ts_id", time_part.alias("time_part"), id_part.alias("id_part"))
