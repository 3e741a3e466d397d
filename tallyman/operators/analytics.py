"""Sales and fulfilment reports over orders, and reports over the event lake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TO_PICK_STATUSES


def county_activity(orders: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Per county, orders of the last ``hours`` before ``as_of``: count, revenue, mean total, items."""
    recent = orders.where(F.col("order_ts") > as_of - F.expr(f"interval {hours} hours"))
    return (
        recent.groupBy("county_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("total").alias("_revenue"),
            F.sum("item_count").alias("items"),
        )
        .select(
            "county_id",
            "orders",
            F.col("_revenue").cast("double").alias("revenue"),
            (F.col("_revenue").cast("double") / F.col("orders")).alias("average_total"),
            "items",
        )
    )


def store_pick_list(lines: DataFrame, statuses: tuple[str, ...] = TO_PICK_STATUSES) -> DataFrame:
    """Per store and sku, what is to be picked for orders in ``statuses``. Needs one line per order and sku."""
    return (
        lines.where(F.col("status").isin(*statuses))
        .groupBy("store_id", "sku")
        .agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("orders"))
    )


def sales_by_period(orders: DataFrame, period: str = "day") -> DataFrame:
    """Orders and revenue per hour, day or month."""
    if period not in ("hour", "day", "month"):
        raise ValueError("period must be hour, day or month")
    return (
        orders.groupBy(F.date_trunc(period, "order_ts").alias("period"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("total").cast("double").alias("revenue"))
    )


def sales_rollup(orders: DataFrame) -> DataFrame:
    """Orders and revenue per county and store with subtotals; ``level`` is 0, 1 (county), 3 (all)."""
    return orders.rollup("county_id", "store_id").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("orders"),
        F.sum("total").cast("double").alias("revenue"),
    )


def lake_events_by_type(lake: DataFrame) -> DataFrame:
    return lake.groupBy("year", "month", "day", "event_type").agg(F.count(F.lit(1)).alias("events"))


def lake_current_status(lake: DataFrame) -> DataFrame:
    """Latest known status per order from its events; events without a status do not count."""
    return (
        lake.where(F.col("status").isNotNull() & (F.col("order_id") != ""))
        .groupBy("order_id")
        .agg(F.max(F.struct("event_timestamp", "status")).alias("_last"))
        .select("order_id", F.col("_last.status").alias("status"), F.col("_last.event_timestamp").alias("status_since"))
    )
