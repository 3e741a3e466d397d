"""Queries: changes to order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import items_text
from ..operators import fulfilment, mutations, notifications
from ..sources import model
from .access_queries import shown
from .oracle_views import sequential_reservation
from .registry import query

_SUMMARY = ("order_id", "customer_id", "status", "payment_state", "updated_at")


def _light_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without their lines: enough for status and payment changes.

    One row per order key, under the id of its first document.
    """
    heads = model.order_heads(spark, sf_dir)
    return heads.withColumn("order_id", model.order_id_of(F.col("orderkey")))




def _insert_sides(spark: SparkSession, sf_dir: str) -> mutations.Mutation:
    rows = _light_orders(spark, sf_dir).select("customer_id", "order_id", "order_ts", "status", "orderkey")
    target = rows.where(F.col("orderkey") % 3 != 0).drop("orderkey").withColumn("arrival", F.lit(0))
    twice = F.explode(F.when(F.col("orderkey") % 8 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    incoming = (
        rows.where(F.col("orderkey") % 2 == 0)
        .withColumn("arrival", twice)
        .withColumn("status", F.when(F.col("arrival") == 1, "PENDING").otherwise("CONFIRMED"))
        .drop("orderkey")
    )
    return mutations.insert_if_absent(target, incoming, ["customer_id", "order_id"], "arrival")


@query("orders_insert_if_absent", ("heads_v",), """
SELECT customer_id, order_id, arrival, orderkey % 3 = 0 AND arrival = 1 AS created,
       CASE WHEN orderkey % 3 = 0 THEN 'PENDING' ELSE status END AS stored_status
FROM heads_v JOIN (VALUES (1), (2)) AS a(arrival) ON arrival = 1 OR orderkey % 8 = 0
WHERE orderkey % 2 = 0
""")
def orders_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insert_sides(spark, sf_dir).outcome


@query("orders_insert_if_absent_table", ("heads_v",), """
SELECT customer_id, order_id, order_ts, CASE WHEN orderkey % 3 = 0 THEN 'PENDING' ELSE status END AS status,
       CASE WHEN orderkey % 3 = 0 THEN 1 ELSE 0 END AS arrival
FROM heads_v WHERE orderkey % 3 <> 0 OR orderkey % 2 = 0
""")
def orders_insert_if_absent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insert_sides(spark, sf_dir).table


# Guarded updates of the model, replayed in SQL by a step per sequence number.
_UPDATE_STEPS = """
, s0 AS (SELECT orderkey, order_id, status AS st0, o_orderdate + INTERVAL 3 DAY AS at0, updated_at
         FROM orders_v JOIN orders ON o_orderkey = orderkey),
s1 AS (SELECT *, orderkey % 4 = 0 AND orderkey % 52 <> 0 AS live FROM s0),
s2 AS (SELECT *, live AND st0 = 'PENDING' AS ok1, CASE WHEN live AND st0 = 'PENDING' THEN 'CONFIRMED' ELSE st0 END AS st1 FROM s1),
s3 AS (SELECT *, live AND orderkey % 8 = 0 AND st1 = 'CONFIRMED' AS ok2,
              CASE WHEN live AND orderkey % 8 = 0 AND st1 = 'CONFIRMED' THEN 'PROCESSING' ELSE st1 END AS st2 FROM s2),
s4 AS (SELECT *, live AND orderkey % 12 = 0 AS ok3, CASE WHEN live AND orderkey % 12 = 0 THEN 'SHIPPED' ELSE st2 END AS st3 FROM s3),
s5 AS (SELECT *, live AND orderkey % 16 = 0 AND st3 = 'PENDING' AS ok4,
              CASE WHEN live AND orderkey % 16 = 0 AND st3 = 'PENDING' THEN 'FAILED' ELSE st3 END AS st4 FROM s4)
"""


@query("status_conditional_update", ("orders_v",), _UPDATE_STEPS + """
SELECT order_id, st4 AS status,
       CASE WHEN ok4 THEN at0 + INTERVAL 4 MINUTE WHEN ok3 THEN at0 + INTERVAL 3 MINUTE
            WHEN ok2 THEN at0 + INTERVAL 2 MINUTE WHEN ok1 THEN at0 + INTERVAL 1 MINUTE ELSE updated_at END AS updated_at
FROM s5
""")
def status_conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = mutations.update_status(_light_orders(spark, sf_dir), model.status_updates(spark, sf_dir))
    return changed.table.select("order_id", "status", "updated_at")


@query("status_update_outcomes", ("orders_v",), _UPDATE_STEPS + """
SELECT CASE WHEN orderkey % 52 = 0 THEN 'ORD-X' || lpad(CAST(orderkey AS VARCHAR), 25, '0') ELSE order_id END AS order_id,
       CAST(seq AS BIGINT) AS seq,
       CASE seq WHEN 1 THEN ok1 WHEN 2 THEN ok2 WHEN 3 THEN ok3 ELSE ok4 END AS applied,
       CASE WHEN live THEN CASE seq WHEN 1 THEN st0 WHEN 2 THEN st1 WHEN 3 THEN st2 ELSE st3 END END AS status_before,
       live AS found
FROM s5 JOIN (VALUES (1, 4), (2, 8), (3, 12), (4, 16)) AS u(seq, every) ON orderkey % every = 0
""")
def status_update_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = mutations.update_status(_light_orders(spark, sf_dir), model.status_updates(spark, sf_dir))
    outcome = changed.outcome
    return outcome.withColumn("status_before", F.when(F.col("found"), F.col("status_before")))


@query("orders_cancel", ("heads_v",), """
SELECT CASE WHEN orderkey % 49 = 0 THEN 'ORD-X' || lpad(CAST(orderkey AS VARCHAR), 25, '0') ELSE order_id END AS order_id,
       CASE WHEN orderkey % 49 = 0 THEN 404 WHEN seen NOT IN ('PENDING', 'CONFIRMED') THEN 409
            WHEN seen <> status THEN 409 ELSE 200 END AS status_code,
       CASE WHEN orderkey % 49 = 0 THEN 'Order not found' WHEN seen NOT IN ('PENDING', 'CONFIRMED')
            THEN 'Order cannot be cancelled' WHEN seen <> status THEN 'Order status changed, please retry'
            ELSE 'Order cancelled successfully' END AS message,
       CASE WHEN orderkey % 49 <> 0 AND seen NOT IN ('PENDING', 'CONFIRMED') THEN seen END AS current_status
FROM (SELECT *, CASE WHEN orderkey % 21 = 0 THEN 'PENDING' ELSE status END AS seen FROM heads_v WHERE orderkey % 7 = 0)
""")
def orders_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = model.latest_order_time(spark, sf_dir)
    return mutations.cancel_orders(_light_orders(spark, sf_dir), model.cancel_requests(spark, sf_dir), as_of).outcome


@query("orders_cancel_table", ("orders_v", "as_of_v"), """
SELECT order_id, CASE WHEN hit THEN 'CANCELLED' ELSE status END AS status,
       CASE WHEN hit THEN as_of ELSE updated_at END AS updated_at
FROM (SELECT *, orderkey % 7 = 0 AND orderkey % 49 <> 0
             AND (status = 'PENDING' OR (status = 'CONFIRMED' AND orderkey % 21 <> 0)) AS hit FROM orders_v), as_of_v
""")
def orders_cancel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = model.latest_order_time(spark, sf_dir)
    changed = mutations.cancel_orders(_light_orders(spark, sf_dir), model.cancel_requests(spark, sf_dir), as_of)
    return changed.table.select("order_id", "status", "updated_at")


@query("payment_apply", ("orders_v",), """
SELECT order_id, status,
       CASE WHEN orderkey % 20 <> 0 AND orderkey % 70 <> 0 THEN 'CAPTURED' ELSE 'FAILED' END AS payment_state,
       o_orderdate + INTERVAL 4 DAY AS updated_at
FROM orders_v JOIN orders ON o_orderkey = orderkey
""")
def payment_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = mutations.apply_payments(_light_orders(spark, sf_dir), model.payment_results(spark, sf_dir)).table
    return paid.select("order_id", "status", "payment_state", "updated_at")


@query("orders_bulk_put", ("orders_v",), """
SELECT order_id, CASE WHEN orderkey % 4 = 0 THEN 'DELIVERED' ELSE status END AS status,
       CASE WHEN orderkey % 4 = 0 THEN 'backfill-' || order_id ELSE idempotency_key END AS idempotency_key,
       CAST(total AS DOUBLE) AS total
FROM orders_v WHERE orderkey % 3 <> 0 OR orderkey % 4 = 0
""")
def orders_bulk_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.orders(spark, sf_dir).select("orderkey", "order_id", "status", "idempotency_key", "total")
    target = rows.where(F.col("orderkey") % 3 != 0).drop("orderkey")
    arrivals = F.explode(F.array(F.lit(1), F.lit(2)))
    incoming = (
        rows.where(F.col("orderkey") % 4 == 0)
        .withColumn("arrival", arrivals)
        .withColumn("status", F.when(F.col("arrival") == 1, "FAILED").otherwise("DELIVERED"))
        .withColumn("idempotency_key", F.concat(F.lit("backfill-"), "order_id"))
        .drop("orderkey")
    )
    return mutations.bulk_put(target, incoming, ["order_id"], "arrival").select(
        "order_id", "status", "idempotency_key", shown("total")
    )


@query("messages_eligible", ("heads_v",), """
SELECT CASE WHEN orderkey % 30 = 0 THEN 'ORD-X' || lpad(CAST(orderkey AS VARCHAR), 25, '0') ELSE order_id END AS order_id,
       CASE WHEN orderkey % 30 = 0 THEN 'not_found' WHEN status <> 'PENDING' THEN 'already_processed' ELSE 'eligible' END AS outcome,
       CASE WHEN orderkey % 30 <> 0 THEN status END AS current_status,
       CAST(orderkey % 5 AS INTEGER) AS attempt
FROM heads_v
""")
def messages_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = fulfilment.classify_messages(model.messages(spark, sf_dir), _light_orders(spark, sf_dir))
    return classified.select("order_id", "outcome", "current_status", "attempt")


def _fulfilled(spark: SparkSession, sf_dir: str) -> fulfilment.Fulfilment:
    orders = _light_orders(spark, sf_dir)
    totals = model.orders(spark, sf_dir).select("order_id", "total")
    payments = mutations.apply_payments(orders, model.payment_results(spark, sf_dir)).outcome
    return fulfilment.fulfil_orders(
        orders.join(totals, "order_id"),
        model.messages(spark, sf_dir),
        model.line_facts(spark, sf_dir, statuses=("PENDING",)),
        model.inventory(spark, sf_dir),
        payments,
        model.latest_order_time(spark, sf_dir),
    )


_PAID = "{0}.orderkey % 20 <> 0 AND {0}.orderkey % 70 <> 0"
_SETTLED = sequential_reservation("h.status = 'PENDING' AND h.orderkey % 30 <> 0", _PAID.format("h")) + f"""
, ended AS (
  SELECT o.*, coalesce(v.reserved, false) AS reserved, {_PAID.format("o")} AS paid
  FROM orders_v o LEFT JOIN verdicts v ON v.order_id = o.order_id WHERE o.orderkey % 30 <> 0 AND o.status = 'PENDING')
"""


@query("orders_settle", ("orders_v", "inventory_v"), _SETTLED + """
SELECT order_id, customer_id, CASE WHEN reserved AND paid THEN 'CONFIRMED' ELSE 'FAILED' END AS status,
       CASE WHEN reserved AND paid THEN CAST(total AS DOUBLE) END AS total,
       CASE WHEN NOT reserved THEN 'Inventory reservation failed' WHEN NOT paid THEN 'Payment processing failed' END AS reason
FROM ended
""")
def orders_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fulfilled(spark, sf_dir).outcome.select("order_id", "customer_id", "status", shown("total"), "reason")


@query("orders_settle_table", ("orders_v", "inventory_v", "as_of_v"), _SETTLED + """
SELECT o.order_id, CASE WHEN e.orderkey IS NULL THEN o.status WHEN e.reserved AND e.paid THEN 'CONFIRMED' ELSE 'FAILED' END AS status,
       CASE WHEN e.orderkey IS NULL THEN o.updated_at ELSE as_of END AS updated_at
FROM orders_v o LEFT JOIN ended e ON e.orderkey = o.orderkey, as_of_v
""")
def orders_settle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fulfilled(spark, sf_dir).orders.select("order_id", "status", "updated_at")


@query("inventory_after_settle", ("orders_v", "inventory_v"), _SETTLED + """
SELECT i.store_sku, i.quantity_available,
       CAST(CASE WHEN t.taken IS NULL THEN i.quantity_reserved ELSE coalesce(i.quantity_reserved, 0) + t.taken END AS INTEGER) AS quantity_reserved
FROM inventory_v i LEFT JOIN (
  SELECT store_sku, sum(quantity) AS taken FROM asked JOIN ended USING (order_id) WHERE reserved AND paid GROUP BY store_sku) t
ON t.store_sku = i.store_sku
""")
def inventory_after_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fulfilled(spark, sf_dir).stock.select("store_sku", "quantity_available", "quantity_reserved")


def _notification_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("orderkey") % 3 == 0, F.lit("card declined")).when(F.col("orderkey") % 3 == 1, F.lit(""))
    return model.orders(spark, sf_dir).select(
        "order_id", "customer_id", "status", "total",
        F.when(F.col("status") == "FAILED", reason).alias("reason"),
    )


_NOTIFIED = """
SELECT 'ORDER_' || status AS type, 'Order ' || order_id || ' - ' || status AS subject, order_id, customer_id,
       strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS timestamp,
       CASE status WHEN 'CONFIRMED' THEN 'Your order has been confirmed!'
         WHEN 'FAILED' THEN 'Unfortunately, your order could not be processed.'
         WHEN 'CANCELLED' THEN 'Your order has been cancelled.' WHEN 'SHIPPED' THEN 'Your order has been shipped!'
         WHEN 'DELIVERED' THEN 'Your order has been delivered!' ELSE 'Order status updated to ' || status END AS message,
       CASE status WHEN 'CONFIRMED' THEN CAST(total AS DOUBLE) END AS total,
       CASE WHEN status = 'FAILED' THEN CASE WHEN orderkey % 3 = 0 THEN 'card declined' ELSE 'Unknown error' END END AS reason,
       CASE status WHEN 'CONFIRMED' THEN 'Your order is being prepared for shipment.'
         WHEN 'FAILED' THEN 'Please try placing your order again or contact support.'
         WHEN 'CANCELLED' THEN 'If you did not request this cancellation, please contact support.'
         WHEN 'SHIPPED' THEN 'Track your package using the tracking number in your email.'
         WHEN 'DELIVERED' THEN 'We hope you enjoy your purchase. Please leave a review!' END AS next_step
FROM orders_v, as_of_v
"""


@query("notifications_build", ("orders_v", "as_of_v"), _NOTIFIED)
def notifications_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = notifications.build_notifications(
        _notification_events(spark, sf_dir), model.latest_order_time(spark, sf_dir)
    )
    return built.select(
        "type", "subject", "order_id", "customer_id", "timestamp", "details.message",
        F.col("details.total").cast("double").alias("total"), "details.reason", "details.next_step",
    )


def _member(name: str, value: str) -> str:
    """One member of a JSON object, or nothing for a null. The texts here need no escapes."""
    return f"""coalesce(',"{name}":' || {value}, '')"""


def _text(value: str) -> str:
    return f"""'"' || {value} || '"'"""


@query("notifications_out", ("orders_v", "as_of_v"), f"""
SELECT subject, order_id, customer_id, substr(type, 7) AS status, type AS event_type,
       '{{"type":"' || type || '"' || {_member("order_id", _text("order_id"))} || {_member("customer_id", _text("customer_id"))}
       || {_member("status", _text("substr(type, 7)"))} || {_member("timestamp", _text("timestamp"))}
       || ',"details":{{"message":"' || message || '"' || {_member("total", "CAST(exact_total AS VARCHAR)")}
       || {_member("reason", _text("reason"))} || {_member("next_step", _text("next_step"))} || '}}}}' AS message
FROM ({_NOTIFIED.replace("SELECT 'ORDER_'", "SELECT CASE status WHEN 'CONFIRMED' THEN total END AS exact_total, 'ORDER_'")})
""")
def notifications_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _notification_events(spark, sf_dir)
    as_of = model.latest_order_time(spark, sf_dir)
    return notifications.notification_messages(notifications.build_notifications(events, as_of))
