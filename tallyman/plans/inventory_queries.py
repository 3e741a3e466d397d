"""Queries: stock and request rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inventory, ledger, rates
from ..session import cut_lineage
from ..sources import model
from .oracle_views import reservation_over_time, sequential_reservation
from .registry import query

RELEASE_AT = "1998-01-01 00:00:00"
# The rate limit that fits the density of the given events.
HITS_ALLOWED = 1


def _open_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.line_facts(spark, sf_dir, statuses=("PENDING",))


_CHECKED = """
, checked AS (
  SELECT l.order_id, l.sku, h.store_id || '#' || l.sku AS store_sku, l.quantity,
         coalesce(quantity_available, 0) - coalesce(quantity_reserved, 0) AS available
  FROM lines_v l JOIN heads_v h ON h.orderkey = l.orderkey
  LEFT JOIN inventory_v i ON i.store_sku = h.store_id || '#' || l.sku
  WHERE h.status = 'PENDING')
"""


@query("inventory_availability", ("heads_v", "lines_v", "inventory_v"), _CHECKED + """
SELECT order_id, sku, store_sku, quantity, CAST(available AS INTEGER) AS available, available >= quantity AS sufficient
FROM checked
""")
def inventory_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = inventory.availability(_open_lines(spark, sf_dir), model.inventory(spark, sf_dir))
    return checked.select("order_id", "sku", "store_sku", "quantity", "available", "sufficient")


@query("reservation_snapshot", ("heads_v", "lines_v", "inventory_v"), _CHECKED + """
SELECT order_id, bool_and(available >= quantity) AS reserved, count(*) FILTER (available < quantity) AS failed_lines,
       CASE WHEN NOT bool_and(available >= quantity) THEN 'Insufficient inventory' END AS error
FROM checked GROUP BY order_id
""")
def reservation_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.snapshot_check(_open_lines(spark, sf_dir), model.inventory(spark, sf_dir))


@query("reservation_shortages", ("heads_v", "lines_v", "inventory_v"), _CHECKED + """
SELECT order_id, sku, quantity AS requested, CAST(available AS INTEGER) AS available
FROM checked WHERE available < quantity
""")
def reservation_shortages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.shortages(_open_lines(spark, sf_dir), model.inventory(spark, sf_dir))


@query("inventory_cumulative_demand", ("heads_v", "lines_v"), """
SELECT l.order_id, h.store_id || '#' || l.sku AS store_sku, l.quantity,
       CAST(sum(l.quantity) OVER (PARTITION BY h.store_id, l.sku ORDER BY h.order_ts, l.order_id
                                  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative
FROM lines_v l JOIN heads_v h ON h.orderkey = l.orderkey
""")
def inventory_cumulative_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = model.line_facts(spark, sf_dir).select("order_id", "order_ts", "store_sku", "quantity")
    return inventory.cumulative_demand(lines).select("order_id", "store_sku", "quantity", "cumulative")


_IN_ORDER = sequential_reservation("h.status = 'PENDING'", "true")


@query("reservation_fcfs", ("heads_v", "lines_v", "inventory_v"), _IN_ORDER + "SELECT order_id, reserved FROM verdicts")
def reservation_fcfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.reserve_in_order(_open_lines(spark, sf_dir), model.inventory(spark, sf_dir))


@query("inventory_after_reserve", ("heads_v", "lines_v", "inventory_v"), _IN_ORDER + """
SELECT i.store_sku, i.quantity_available,
       CAST(CASE WHEN t.taken IS NULL THEN i.quantity_reserved ELSE coalesce(i.quantity_reserved, 0) + t.taken END AS INTEGER) AS quantity_reserved
FROM inventory_v i LEFT JOIN (
  SELECT store_sku, sum(quantity) AS taken FROM asked JOIN verdicts USING (order_id) WHERE reserved GROUP BY store_sku) t
ON t.store_sku = i.store_sku
""")
def inventory_after_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, stock = _open_lines(spark, sf_dir), model.inventory(spark, sf_dir)
    verdicts = inventory.reserve_in_order(lines, stock)
    held = inventory.reservations(lines, verdicts, model.latest_order_time(spark, sf_dir))
    return inventory.add_reservations(stock, held).select("store_sku", "quantity_available", "quantity_reserved")


_HELD = reservation_over_time("true", """CASE WHEN h.payment_state = 'CAPTURED' THEN h.order_ts + INTERVAL 180 DAY
                          WHEN h.payment_state = 'PENDING' THEN h.order_ts + INTERVAL 30 MINUTE
                          WHEN h.payment_state = 'FAILED' THEN h.order_ts END""")


def _held_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all orders. Stock of paid orders is back with a delivery half a year on, unpaid orders hold theirs for half
    an hour, failed ones give it back at once, refunded ones keep it from sale."""
    payment = F.col("payment_state")
    until = (
        F.when(payment == "CAPTURED", F.col("order_ts") + F.expr("interval 180 days"))
        .when(payment == "PENDING", F.col("order_ts") + F.expr("interval 30 minutes"))
        .when(payment == "FAILED", F.col("order_ts"))
    )
    heads = model.order_heads(spark, sf_dir).select("orderkey", "order_ts", "store_id", until.alias("until"))
    lines = model.order_lines(spark, sf_dir).select("orderkey", "order_id", "sku", "quantity").join(heads, "orderkey")
    return lines.select("order_id", "order_ts", F.concat_ws("#", "store_id", "sku").alias("store_sku"), "quantity", "until")


@query("reservation_over_time", ("heads_v", "lines_v", "inventory_v"), _HELD + "SELECT order_id, reserved FROM verdicts")
def reservation_over_time_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.reserve_over_time(_held_lines(spark, sf_dir), model.inventory(spark, sf_dir))


@query("inventory_held_over_time", ("heads_v", "lines_v", "inventory_v"), _HELD + """
, moves AS (
  SELECT store_sku, order_ts AS "at", quantity FROM asked JOIN verdicts USING (order_id) WHERE reserved AND until > order_ts
  UNION ALL
  SELECT store_sku, until, -quantity FROM asked JOIN verdicts USING (order_id)
  WHERE reserved AND until > order_ts AND until < TIMESTAMP '9999-12-31')
SELECT store_sku, "at", CAST(sum(sum(quantity)) OVER (PARTITION BY store_sku ORDER BY "at") AS BIGINT) AS held
FROM moves GROUP BY store_sku, "at"
""")
def inventory_held_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The lines are read for the verdicts and for what is held.
    lines = cut_lineage(_held_lines(spark, sf_dir), "held-lines")
    verdicts = ledger.reserve_over_time(lines, model.inventory(spark, sf_dir))
    return ledger.held_over_time(lines, verdicts)


@query("inventory_release", ("heads_v", "lines_v", "inventory_v"), f"""
SELECT i.store_sku,
       CAST(CASE WHEN d.given IS NULL THEN i.quantity_reserved
                 ELSE greatest(coalesce(i.quantity_reserved, 0) - d.given, 0) END AS INTEGER) AS quantity_reserved
FROM inventory_v i LEFT JOIN (
  SELECT h.store_id || '#' || l.sku AS store_sku, sum(l.quantity) AS given
  FROM lines_v l JOIN heads_v h ON h.orderkey = l.orderkey
  WHERE h.status = 'PENDING' AND (h.orderkey % 6 = 0 OR h.order_ts + INTERVAL 30 MINUTE <= TIMESTAMP '{RELEASE_AT}')
  GROUP BY 1) d ON d.store_sku = i.store_sku
""")
def inventory_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _open_lines(spark, sf_dir)
    held = lines.select(
        "order_id", "store_sku", "quantity", F.lit("PENDING").alias("status"), "orderkey",
        (F.col("order_ts") + F.expr("interval 30 minutes")).alias("expires_at"),
    )
    failed = held.where(F.col("orderkey") % 6 == 0)
    as_of = F.lit(RELEASE_AT).cast("timestamp")
    stock, _ = inventory.release(model.inventory(spark, sf_dir), held, failed, as_of)
    return stock.select("store_sku", "quantity_reserved")


@query("inventory_apply_deltas", ("heads_v", "lines_v", "inventory_v"), """
SELECT i.store_sku, CAST(greatest(i.quantity_available + coalesce(d.delta, 0), 0) AS INTEGER) AS quantity_available
FROM inventory_v i LEFT JOIN (
  SELECT h.store_id || '#' || l.sku AS store_sku, sum(CASE WHEN l.orderkey % 2 = 0 THEN l.quantity ELSE -l.quantity END) AS delta
  FROM lines_v l JOIN heads_v h ON h.orderkey = l.orderkey WHERE h.status = 'DELIVERED' GROUP BY 1) d
ON d.store_sku = i.store_sku
""")
def inventory_apply_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = model.line_facts(spark, sf_dir, statuses=("DELIVERED",)).select(
        "store_sku",
        F.when(F.col("orderkey") % 2 == 0, F.col("quantity")).otherwise(-F.col("quantity")).alias("quantity_delta"),
    )
    return inventory.apply_deltas(model.inventory(spark, sf_dir), moved).select("store_sku", "quantity_available")


@query("rate_limit_violations", (), f"""
SELECT key, start AS window_start, start + INTERVAL 5 MINUTE AS window_end, count(*) AS hits
FROM (SELECT event_type AS key, date_trunc('minute', ts) - to_minutes(back) AS start
      FROM events CROSS JOIN range(5) AS r(back))
GROUP BY key, start HAVING count(*) > {HITS_ALLOWED}
""")
def rate_limit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = model.table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key")
    )
    return rates.rate_violations(hits, HITS_ALLOWED)
