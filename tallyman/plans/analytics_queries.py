"""Queries: sales and fulfilment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics
from ..schemas import TO_PICK_STATUSES
from ..session import cut_lineage, working_path
from ..sources import model
from ..streaming.reports import SalesReports
from .registry import query

# Buckets of a report that a query builds for itself.
REPORT_BUCKETS = 8


def _with_item_count(orders: DataFrame) -> DataFrame:
    return orders.withColumn("item_count", F.size("items"))


@query("county_last_24h", ("orders_v", "as_of_v"), """
SELECT county_id, count(*) AS orders, CAST(sum(total) AS DOUBLE) AS revenue,
       CAST(sum(total) AS DOUBLE) / count(*) AS average_total, CAST(sum(item_count) AS BIGINT) AS items
FROM orders_v, as_of_v WHERE order_ts > as_of - INTERVAL 24 HOUR
GROUP BY county_id
""")
def county_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = model.latest_order_time(spark, sf_dir)
    recent = model.orders(spark, sf_dir, since=(as_of - F.expr("interval 24 hours")))
    return analytics.county_activity(_with_item_count(recent), as_of)


@query("store_pick_list", ("heads_v", "lines_v"), """
SELECT store_id, sku, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS orders
FROM lines_v JOIN heads_v USING (orderkey)
WHERE status IN ('CONFIRMED', 'PROCESSING') GROUP BY store_id, sku
""")
def store_pick_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.store_pick_list(model.line_facts(spark, sf_dir, statuses=TO_PICK_STATUSES))


@query("sales_by_day", ("orders_v",), """
SELECT date_trunc('day', order_ts) AS period, count(*) AS orders, CAST(sum(total) AS DOUBLE) AS revenue
FROM orders_v GROUP BY 1
""")
def sales_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sales_by_period(model.orders(spark, sf_dir), "day")


@query("sales_by_hour", ("orders_v",), """
SELECT date_trunc('hour', order_ts) AS period, count(*) AS orders, CAST(sum(total) AS DOUBLE) AS revenue
FROM orders_v GROUP BY 1
""")
def sales_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sales_by_period(model.orders(spark, sf_dir), "hour")


@query("sales_by_month", ("orders_v",), """
SELECT CAST(date_trunc('month', order_ts) AS TIMESTAMP) AS period, count(*) AS orders,
       CAST(sum(total) AS DOUBLE) AS revenue
FROM orders_v GROUP BY 1
""")
def sales_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sales_by_period(model.orders(spark, sf_dir), "month")


@query("sales_rollup", ("orders_v",), """
SELECT county_id, store_id, CAST(grouping(county_id) * 2 + grouping(store_id) AS INTEGER) AS level,
       count(*) AS orders, CAST(sum(total) AS DOUBLE) AS revenue
FROM orders_v GROUP BY ROLLUP (county_id, store_id)
""")
def sales_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sales_rollup(model.orders(spark, sf_dir))


@query("sales_incremental", ("changes_v",), """
SELECT county_id, store_id, status, date_trunc('day', order_ts) AS period, count(*) AS orders,
       CAST(sum(total) AS DOUBLE) AS revenue, CAST(sum(item_count) AS BIGINT) AS items
FROM (SELECT county_id, store_id, new_status AS status, order_ts, total, item_count, op,
             row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) AS rn
      FROM changes_v WHERE has_new OR op = 'REMOVE')
WHERE rn = 1 AND op <> 'REMOVE' GROUP BY ALL
""")
def sales_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed in two batches, the later changes first. Items are counted before the feed is stored, not stored with it."""
    new = F.col("new_image")
    kept = [new[c].alias(c) for c in ("order_ts", "county_id", "store_id", "status", "total")]
    kept.append(F.size(new["items"]).alias("item_count"))
    feed = cut_lineage(
        model.changes(spark, sf_dir).select(
            "order_id", "seq", "op", F.when(new.isNotNull(), F.struct(*kept)).alias("new_image")
        )
    )
    reports = SalesReports(spark, working_path(spark, "sales"), REPORT_BUCKETS)
    for number, batch in enumerate((feed.where("seq > 1"), feed.where("seq <= 1"))):
        reports.write_batch(batch, number)
    return reports.sales("day", ("county_id", "store_id", "status"))
