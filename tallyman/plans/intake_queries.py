"""Queries: intake, pricing and idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import rolling_hash
from ..functions.keys import ID_DIGITS, id_time, is_customer_id, is_iso_datetime, is_order_id, is_uuid, iso_millis, sortable_id
from ..functions.text import items_text
from ..operators import intake, pricing
from ..session import cut_lineage
from ..sources import model
from .access_queries import shown
from .registry import query


def errors_text(errors: Column) -> Column:
    return F.array_join(F.transform(errors, lambda e: F.concat(e["field"], F.lit(":"), e["code"])), ",")


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.validate_requests(intake.parse_requests(model.requests(spark, sf_dir)))


@query("requests_parse", ("checked_v",), """
SELECT request_id,
       CASE WHEN kind IN (0, 1) THEN 'required' WHEN kind IN (2, 25) THEN 'invalid_json' END AS parse_error,
       CASE WHEN kind IN (0, 1, 2, 13, 18, 25, 30) THEN NULL WHEN kind IN (3, 31) THEN ''
            WHEN kind = 14 THEN '123' ELSE customer_id END AS customer_id,
       CASE WHEN kind IN (0, 1, 2, 18, 25, 30) THEN NULL ELSE county_id END AS county_id,
       CASE WHEN kind IN (0, 1, 2, 15, 18, 19, 25, 30) THEN NULL WHEN kind = 4 THEN 0 ELSE item_count END AS item_count,
       CASE WHEN kind IN (0, 1, 2, 16, 18, 25, 30, 34) THEN NULL WHEN kind = 10 THEN '1234'
            WHEN kind = 24 THEN '12345678901' ELSE zip END AS zip
FROM checked_v
""")
def requests_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = intake.parse_requests(model.requests(spark, sf_dir))
    items = F.col("request.items")
    return parsed.select(
        "request_id",
        "parse_error",
        "request.customer_id",
        "request.county_id",
        F.when(items.isNotNull(), F.size(items)).alias("item_count"),
        F.col("request.shipping_address.zip").alias("zip"),
    )


@query("requests_validate", ("checked_v",), """
SELECT request_id, errors, errors = '' AS is_valid,
       kind NOT IN (11, 17, 26) AS key_well_formed
FROM checked_v
""")
def requests_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select(
        "request_id", errors_text(F.col("errors")).alias("errors"), "is_valid", "key_well_formed"
    )


@query("requests_rejected", ("checked_v",), """
SELECT CASE WHEN errors LIKE '%,%' THEN 'several' ELSE split_part(errors, ':', 2) END AS code, count(*) AS requests
FROM checked_v WHERE errors <> '' GROUP BY 1
""")
def requests_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.size("errors") > 1, "several").otherwise(F.col("errors")[0]["code"])
    return intake.rejected(validated(spark, sf_dir)).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("requests"))


@query("order_totals", ("orders_v",), """
SELECT order_id, items_text AS items, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax AS DOUBLE) AS tax,
       CAST(total AS DOUBLE) AS total FROM orders_v
""")
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    unpriced = model.orders(spark, sf_dir).select("order_id", "items")
    priced = pricing.price_orders(unpriced)
    return priced.select("order_id", *[shown(c) for c in ("items", "subtotal", "tax", "total")])


@query("requests_idempotent", ("checked_v",), """
SELECT r.request_id, 'REQ-' || r.order_id || '-1' AS first_request_id, send = 1 AS created,
       CASE WHEN send = 1 THEN 201 ELSE 200 END AS status_code,
       CASE WHEN send = 2 THEN 'Order already exists (idempotent)' END AS message
FROM checked_v r
WHERE errors = '' AND kind <> 17
UNION ALL
SELECT r.request_id, first_value(request_id) OVER w, row_number() OVER w = 1,
       CASE WHEN row_number() OVER w = 1 THEN 201 ELSE 200 END,
       CASE WHEN row_number() OVER w > 1 THEN 'Order already exists (idempotent)' END
FROM checked_v r WHERE kind = 17
WINDOW w AS (PARTITION BY customer_id ORDER BY received_at, request_id)
""")
def requests_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The outcome joins the requests with their own firsts: parse them once.
    keys = intake.accepted(validated(spark, sf_dir)).select(
        "request_id", "received_at", "customer_id", "idempotency_key"
    )
    outcome = intake.idempotent_intake(cut_lineage(keys, "accepted"))
    return outcome.select("request_id", "first_request_id", "created", "status_code", "message")


@query("idempotency_conflicts", ("checked_v", "lines_v"), """
SELECT customer_id, request_key AS idempotency_key, CAST(2 AS BIGINT) AS payloads, CAST(2 AS BIGINT) AS requests
FROM checked_v WHERE kind = 22 AND send = 1
UNION ALL
SELECT customer_id, 'short', count(DISTINCT payload), count(*)
FROM (SELECT customer_id, store_id || ' ' || items_text AS payload FROM checked_v WHERE kind = 17)
GROUP BY customer_id HAVING count(DISTINCT payload) > 1
""")
def idempotency_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.idempotency_conflicts(intake.accepted(validated(spark, sf_dir)))


@query("orders_from_requests", ("checked_v", "lines_v"), """
SELECT customer_id, 'PENDING' AS status, received_at AS order_ts, request_id,
       CAST(CASE WHEN kind = 32 THEN CAST((subtotal - f.total_price + 2 * f.unit_price) * 1.08 AS DECIMAL(23,4))
                 ELSE total END AS DOUBLE) AS total
FROM checked_v c
JOIN (SELECT * FROM lines_v QUALIFY row_number() OVER (PARTITION BY orderkey ORDER BY sku) = 1) f USING (orderkey)
WHERE errors = '' AND send = 1
QUALIFY kind <> 17 OR row_number() OVER (PARTITION BY kind, customer_id ORDER BY received_at, request_id) = 1
""")
def orders_from_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = intake.accepted(validated(spark, sf_dir))
    first = intake.idempotent_intake(cut_lineage(valid, "accepted")).where("created")
    return intake.build_orders(first).select("customer_id", "status", "order_ts", "request_id", shown("total"))


@query("orders_validate", ("lines_v", "orders_v"), """
SELECT o.order_id,
       coalesce(string_agg(CASE WHEN l.partkey % 29 = 0 THEN 'items.' || l.i || '.total_price:too_small' END, ','
                           ORDER BY l.i), '') AS errors
FROM orders_v o
LEFT JOIN (SELECT orderkey, partkey, row_number() OVER (PARTITION BY orderkey ORDER BY sku) - 1 AS i FROM lines_v) l
  ON l.orderkey = o.orderkey
GROUP BY o.order_id
""")
def orders_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines of every 29th part get a total of zero, so that there is something to find.
    spoiled = F.transform(
        "items",
        lambda x: x.withField(
            "total_price",
            F.when(F.substring(x["sku"], 5, 12).cast("bigint") % 29 == 0, F.lit(0).cast("decimal(18,2)"))
            .otherwise(x["total_price"]),
        ),
    )
    stored = model.orders(spark, sf_dir).withColumn("items", spoiled)
    return intake.validate_orders(stored).select("order_id", errors_text(F.col("errors")).alias("errors"))


@query("inventory_validate", ("inventory_v",), """
SELECT store_sku, concat_ws(',',
         CASE WHEN product_name = '' THEN 'product_name:too_small' END,
         CASE WHEN quantity_reserved IS NULL THEN 'quantity_reserved:invalid_type' END,
         CASE WHEN reorder_level < 0 THEN 'reorder_level:too_small' END,
         CASE WHEN cost_sign = 0 THEN 'unit_cost:too_small' END) AS errors
FROM inventory_v
""")
def inventory_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = intake.validate_inventory(model.inventory(spark, sf_dir))
    return checked.select("store_sku", errors_text(F.col("errors")).alias("errors"))


@query("id_format_checks", ("heads_v",), """
SELECT id, length(id) = 30 AND regexp_full_match(id, 'ORD-[0-9A-Z]{26}') AS order_id_ok,
       regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS uuid_ok,
       length(id) BETWEEN 1 AND 128 AS customer_id_ok,
       regexp_full_match(id, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}[.]000Z') AS datetime_ok
FROM (SELECT CASE orderkey % 4 WHEN 0 THEN order_id
                  WHEN 1 THEN substr(md5(order_id), 1, 8) || '-' || substr(md5(order_id), 9, 4) || '-' ||
                              substr(md5(order_id), 13, 4) || '-' || substr(md5(order_id), 17, 4) || '-' ||
                              substr(md5(order_id), 21, 12)
                  WHEN 2 THEN strftime(order_ts, '%Y-%m-%dT%H:%M:%S') || '.000Z'
                  ELSE repeat(customer_id, 1 + CAST(orderkey % 12 AS INTEGER)) END AS id
      FROM heads_v)
""")
def id_format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("orderkey")
    order_id = model.order_id_of(key)
    digest = F.md5(order_id.cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    some_id = (
        F.when(key % 4 == 0, order_id)
        .when(key % 4 == 1, uuid)
        .when(key % 4 == 2, iso_millis(F.col("order_ts")))
        .otherwise(F.expr("repeat(customer_id, 1 + cast(orderkey % 12 as int))"))
    )
    ids = model.order_heads(spark, sf_dir).select(some_id.alias("id"))
    text = F.col("id")
    return ids.select(
        "id",
        is_order_id(text).alias("order_id_ok"),
        is_uuid(text).alias("uuid_ok"),
        is_customer_id(text).alias("customer_id_ok"),
        is_iso_datetime(text).alias("datetime_ok"),
    )


@query("rolling_hash", (), """
SELECT c_custkey, lower(to_hex(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END)) AS hash
FROM (SELECT c_custkey,
             list_reduce(list_transform(string_split('{"customer":"' || c_name || '","segment":"' || c_mktsegment || '"}', ''),
                                        lambda x: CAST(unicode(x) AS BIGINT)),
                         lambda a, c: (a * 31 + c) & 4294967295, CAST(0 AS BIGINT)) AS h
      FROM customer)
""")
def rolling_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct(F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment")))
    return model.table(spark, sf_dir, "customer").select("c_custkey", rolling_hash(text).alias("hash"))


def _digits(value: str, width: int) -> str:
    """Base-32 digits of a number, in DuckDB."""
    return (f"list_aggregate(list_transform(range({width}), lambda i: substr('{ID_DIGITS}', "
            f"CAST((({value}) >> (5 * ({width - 1} - i))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')")


@query("sortable_ids", ("heads_v",), f"""
SELECT orderkey, order_ts, 'ORD-' || tail AS order_id, 'RES-' || tail AS reservation_id, order_ts AS id_time FROM (
  SELECT orderkey, order_ts, {_digits("CAST(epoch_ms(order_ts) AS BIGINT)", 10)}
         || {_digits("CAST('0x' || substr(digest, 1, 10) AS BIGINT)", 8)} || {_digits("CAST('0x' || substr(digest, 11, 10) AS BIGINT)", 8)} AS tail
  FROM (SELECT *, md5(CAST(orderkey AS VARCHAR)) AS digest FROM heads_v))
""")
def sortable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = model.order_heads(spark, sf_dir)
    new_id = sortable_id("ORD-", F.col("order_ts"), F.col("orderkey"))
    held = sortable_id("RES-", F.col("order_ts"), F.col("orderkey"))
    made = heads.select("orderkey", "order_ts", new_id.alias("order_id"), held.alias("reservation_id"))
    return made.withColumn("id_time", id_time(F.col("order_id")))
