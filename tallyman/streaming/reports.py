"""Reports that follow the change feed and the lake: partial states, merged by each batch and finished when read.

A batch appends what it changes and never rewrites a report, so its cost follows the batch: sums are kept as signed
differences, last values with the number or time that ranks them. Tiers of appended folders are combined as they are merged
(``sources.tables``). A batch counts when its commit does, and one that has been committed is not taken again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import analytics
from ..sources.tables import BUCKETS, FAN, BucketedTable, State, Store, is_applied, mark_applied
from .feeds import FEED_INTERVAL, LAKE_INTERVAL, run_of, start

CELL = ["county_id", "store_id", "status", "period"]
EVENT_CELL = ["year", "month", "day", "event_type"]


def order_facts(changes: DataFrame) -> DataFrame:
    """What the sales reports need of each change; ``live`` is false for a removal. Changes without images say nothing.

    Images may hold ``item_count`` in place of ``items``.
    """
    new, removed = F.col("new_image"), F.col("op") == "REMOVE"
    counted = "item_count" in changes.schema["new_image"].dataType.names
    item_count = new["item_count"] if counted else F.size(new["items"])
    told = changes.where(F.col("order_id").isNotNull() & (new.isNotNull() | removed))
    return told.select(
        "order_id", "seq", (~removed).alias("live"), new["order_ts"].alias("order_ts"),
        new["county_id"].alias("county_id"), new["store_id"].alias("store_id"), new["status"].alias("status"),
        new["total"].cast("decimal(23,4)").alias("total"), item_count.cast("long").alias("item_count"),
    )


def newest_facts(facts: DataFrame) -> DataFrame:
    """The facts with the highest ``seq`` of each order."""
    row = F.struct(*facts.columns)
    return facts.groupBy(F.col("order_id").alias("_key")).agg(F.max_by(row, "seq").alias("_row")).select("_row.*")


def summed_cells(cells: DataFrame) -> DataFrame:
    """One row a cell; cells that have gone to nothing are left out."""
    summed = cells.groupBy(*CELL).agg(
        F.sum("orders").alias("orders"), F.sum("revenue").cast("decimal(38,4)").alias("revenue"), F.sum("items").alias("items")
    )
    return summed.where("orders != 0 OR revenue != 0 OR items != 0")


def _difference(before: Column, after: Column) -> Column:
    """The cells an order leaves and enters, as an array of signed rows."""

    def cell(facts: Column, sign: int) -> Column:
        times = F.lit(sign)
        return F.when(
            facts["live"],
            F.struct(
                facts["county_id"].alias("county_id"), facts["store_id"].alias("store_id"), facts["status"].alias("status"),
                F.date_trunc("hour", facts["order_ts"]).alias("period"), times.cast("long").alias("orders"),
                (facts["total"] * times).cast("decimal(38,4)").alias("revenue"),
                (facts["item_count"] * times).alias("items"),
            ),
        )

    return F.array_compact(F.array(cell(before, -1), cell(after, 1)))


class SalesReports:
    """Orders, revenue and items per county, store, status and hour, as the newest image of each order has them.

    An order's earlier facts are fetched by key (Bloom filters tell which folders to open) and taken out of their cell when
    newer ones go into theirs. Late, repeated and removed changes leave the reports as the whole feed would.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan: int = FAN):
        self.store = Store(spark, root)
        self.orders = BucketedTable(self.store, "orders", ["order_id"], buckets, filters=True, fan=fan)
        self.cells = BucketedTable(self.store, "cells", CELL, buckets, fan=fan)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Take a batch of the change feed."""
        run, state = run_of(batch), self.store.state()
        if is_applied(state, run, batch_id):
            return
        newest = newest_facts(order_facts(batch))
        after = newest.select("order_id", F.struct(*newest.columns).alias("after")).persist()
        stored = self.orders.fetch(after, state)
        if stored is None:
            stored = newest.limit(0)
        before = newest_facts(stored).select("order_id", F.struct(*newest.columns).alias("before"))
        changed = after.join(before, "order_id", "left").where("before IS NULL OR after.seq > before.seq").persist()
        try:
            cells = changed.select(F.inline(_difference(F.col("before"), F.col("after"))))
            added = [self.orders.append(changed.select("after.*")), self.cells.append(summed_cells(cells))]

            def change(found: State) -> None:
                if found["applied"] != state["applied"]:
                    raise RuntimeError("another stream has changed the reports meanwhile; the batch runs again")
                for each in added:
                    each(found)
                mark_applied(found, run, batch_id)

            self.store.commit(change)
        finally:
            changed.unpersist()
            after.unpersist()
        self.orders.merge(newest_facts)
        self.cells.merge(summed_cells)

    def start(self, changes: DataFrame, checkpoint: str, interval: str | None = FEED_INTERVAL) -> StreamingQuery:
        return start(changes.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint), interval)

    def sales(self, period: str = "hour", by: tuple[str, ...] = ()) -> DataFrame:
        """Orders, revenue and items per hour, day or month, and per ``by`` (``county_id``, ``store_id``, ``status``)."""
        if period not in ("hour", "day", "month"):
            raise ValueError("period must be hour, day or month")
        sums = self.cells.read().groupBy(*by, F.date_trunc(period, "period").alias("period")).agg(
            F.sum("orders").alias("orders"), F.sum("revenue").cast("double").alias("revenue"), F.sum("items").alias("items")
        )
        return sums.where("orders != 0")

    def rollup(self) -> DataFrame:
        """As :func:`operators.analytics.sales_rollup`."""
        sums = self.cells.read().rollup("county_id", "store_id").agg(
            F.grouping_id().cast("int").alias("level"), F.sum("orders").alias("orders"),
            F.sum("revenue").cast("double").alias("revenue"),
        )
        return sums.where("orders != 0")

    def county_activity(self, as_of: Column, hours: int = 24) -> DataFrame:
        """As :func:`operators.analytics.county_activity`: whole hours from the cells, the first one from its orders."""
        state, since = self.store.state(), as_of - F.expr(f"interval {hours} hours")
        whole = self.cells.read(state=state).where(F.col("period") > since)
        facts = newest_facts(self.orders.read(state=state))
        started = F.date_trunc("hour", since)
        edge = facts.where(F.col("live") & (F.col("order_ts") > since) & (F.date_trunc("hour", "order_ts") == started))
        edge = edge.where(started <= since).select(
            "county_id", F.lit(1).cast("long").alias("orders"), F.col("total").cast("decimal(38,4)").alias("revenue"),
            F.col("item_count").alias("items"),
        )
        both = whole.select(*edge.columns).unionByName(edge)
        sums = both.groupBy("county_id").agg(
            F.sum("orders").alias("orders"), F.sum("revenue").cast("double").alias("revenue"), F.sum("items").alias("items")
        )
        return sums.where("orders != 0").select(
            "county_id", "orders", "revenue", (F.col("revenue") / F.col("orders")).alias("average_total"), "items"
        )


def summed_events(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*EVENT_CELL).agg(F.sum("events").alias("events"))


def newest_status(known: DataFrame) -> DataFrame:
    """The latest status of each order, as :func:`operators.analytics.lake_current_status` ranks them."""
    last = F.max(F.struct("status_since", "status")).alias("_last")
    return known.groupBy("order_id").agg(last).select("order_id", "_last.status", "_last.status_since")


class LakeReports:
    """Events per day and type, and the current status of each order, from batches of lake rows with their partitions."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan: int = FAN):
        self.store = Store(spark, root)
        self.counts = BucketedTable(self.store, "counts", EVENT_CELL, buckets, fan=fan)
        self.known = BucketedTable(self.store, "known", ["order_id"], buckets, fan=fan)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch)
        if is_applied(self.store.state(), run, batch_id):
            return
        rows = batch.select(*EVENT_CELL, "order_id", "status", "event_timestamp").persist()
        try:
            # Sums and last values can be put together in any order, so batches of other streams do not matter.
            added = [
                self.counts.append(analytics.lake_events_by_type(rows)),
                self.known.append(analytics.lake_current_status(rows)),
            ]

            def change(found: State) -> None:
                if is_applied(found, run, batch_id):
                    return
                for each in added:
                    each(found)
                mark_applied(found, run, batch_id)

            self.store.commit(change)
        finally:
            rows.unpersist()
        self.counts.merge(summed_events)
        self.known.merge(newest_status)

    def start(self, rows: DataFrame, checkpoint: str, interval: str | None = LAKE_INTERVAL) -> StreamingQuery:
        return start(rows.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint), interval)

    def events_by_type(self) -> DataFrame:
        return summed_events(self.counts.read())

    def current_status(self) -> DataFrame:
        return newest_status(self.known.read())
